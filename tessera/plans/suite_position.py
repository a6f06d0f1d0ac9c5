"""Registered queries: positional operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import position
from tessera.plans.registry import register
from tessera.sources.tables import load


@register("zip_with_index", oracle="""
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, o_custkey FROM orders
""")
def zip_with_index(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return position.row_index(o, ["o_orderkey"])


@register("zip_with_index_input_order", oracle="""
SELECT count(*) AS n, count(*) AS n_distinct, CAST(0 AS BIGINT) AS min_idx, count(*) - 1 AS max_idx FROM lineitem
""")
def zip_with_index_input_order(spark, sf_dir):
    z = position.zip_with_index(load(spark, sf_dir, "lineitem").select("l_orderkey"), stable_input=True)
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("n_distinct"),
                 F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"))


@register("zip_with_unique_id", oracle="SELECT count(*) AS n, count(*) AS n_distinct FROM lineitem")
def zip_with_unique_id(spark, sf_dir):
    z = position.zip_with_unique_id(load(spark, sf_dir, "lineitem").select("l_orderkey"))
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_distinct"))


@register("zip_positional", oracle="""
WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey FROM customer),
     b AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx, c_custkey AS c_custkey_2, c_acctbal
           FROM customer)
SELECT idx, c_custkey, c_custkey_2, c_acctbal FROM a JOIN b USING (idx)
""")
def zip_positional(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    a = c.select("c_custkey")
    b = c.select("c_custkey", "c_acctbal")
    z = position.zip_frames(a, b, ["c_custkey"], ["c_acctbal", "c_custkey"])
    return z.select("idx", "c_custkey", "c_custkey_2", "c_acctbal")


@register("zip_with_index_after_shuffle", oracle="""
SELECT count(*) AS n, count(*) AS n_distinct, CAST(0 AS BIGINT) AS min_idx, count(*) - 1 AS max_idx
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
""")
def zip_with_index_after_shuffle(spark, sf_dir):
    z = position.zip_with_index(load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct())
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("n_distinct"),
                 F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"))
