"""Registered queries: keyed aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.plans.oracle_sql import chunks_sql
from tessera.operators.rows import project_keys
from tessera.plans.registry import register
from tessera.sources.tables import load

#: Values of one row: small enough that most keys are split.
PER_CUSTOMER, PER_YEAR, PER_FLAG = 4, 500, 900


def _text(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


@register("key_combine", oracle="""
SELECT o_custkey AS k, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS statuses
FROM orders GROUP BY o_custkey
""")
def key_combine(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")
    # combineByKey(str, c + str(v), c1 + c2): concatenation, order-free view = sorted characters
    c = keyed.combine_by_key(p, str, lambda acc, v: acc + str(v), lambda a, b: a + b)
    return c.select("k", F.array_join(F.array_sort(F.split("v", "", -1)), "").alias("statuses"))


@register("key_reduce_sum", oracle="""
SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1
""")
def key_reduce_sum(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    p = project_keys(o, "o_custkey", F.col("o_totalprice").cast("decimal(18,2)"))
    return keyed.reduce_by_key(p, "sum").select("k", F.col("v").cast("double").alias("v"))


@register("key_reduce_max", oracle="SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem GROUP BY 1")
def key_reduce_max(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")
    return keyed.reduce_by_key(p, "max")


@register("key_aggregate_sum_count", oracle="""
SELECT l_suppkey AS k, sum(l_quantity) AS sum, count(*) AS count FROM lineitem GROUP BY 1
""")
def key_aggregate_sum_count(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return keyed.aggregate_by_key(p)


@register("key_fold_product", oracle="""
SELECT l_orderkey AS k, CAST(product(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1
""")
def key_fold_product(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return keyed.fold_by_key(p, 1, "product").select("k", F.col("v").cast("long").alias("v"))


@register("key_group", oracle=f"""
WITH t AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders), {chunks_sql('t', 'k', 'v', PER_CUSTOMER)}
SELECT k, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, array_to_string(list_sort(list(v)), ',') AS vals
FROM r GROUP BY k, chunk
""")
def key_group(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    g = keyed.group_by_key(p, chunk_rows=PER_CUSTOMER)
    return g.select("k", F.col("chunk").cast("long").alias("chunk"), F.size("values").cast("long").alias("n"),
                    _text("values").alias("vals"))


@register("key_group_by_expr", oracle=f"""
WITH t AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS k, o_orderkey AS v FROM orders), {chunks_sql('t', 'k', 'v', PER_YEAR)}
SELECT k, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, CAST(sum(v) AS BIGINT) AS total,
       array_to_string(list_sort(list(v)), ',') AS vals
FROM r GROUP BY k, chunk
""")
def key_group_by_expr(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    g = keyed.group_by(o, F.year("o_orderdate").cast("long"), "o_orderkey", chunk_rows=PER_YEAR)
    return g.select("k", F.col("chunk").cast("long").alias("chunk"), F.size("values").cast("long").alias("n"),
                    F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                    _text("values").alias("vals"))


@register("key_group_repeated", oracle=f"""
WITH t AS (SELECT l_returnflag AS k, CASE WHEN l_linenumber >= 3 THEN l_linestatus || l_linenumber END AS v FROM lineitem),
{chunks_sql('t', 'k', 'v', PER_FLAG)}
SELECT k, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS vals, count(v) AS known
FROM r GROUP BY k, chunk
""")
def key_group_repeated(spark, sf_dir):
    """Few keys with few distinct values, a third of them null: whole chunks of one value and mixed ones."""
    v = F.when(F.col("l_linenumber") >= 3, F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    g = keyed.group_by_key(project_keys(load(spark, sf_dir, "lineitem"), "l_returnflag", v), chunk_rows=PER_FLAG)
    known = F.filter("values", lambda x: x.isNotNull())
    return g.select("k", F.col("chunk").cast("long").alias("chunk"), F.size("values").cast("long").alias("n"),
                    F.array_join(F.array_sort(F.array_distinct(known)), ",").alias("vals"), F.size(known).cast("long").alias("known"))


@register("key_count", oracle="SELECT l_suppkey AS k, count(*) AS count FROM lineitem GROUP BY 1")
def key_count(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return keyed.count_by_key(p)


@register("key_last_value", oracle="""
SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1
""")
def key_last_value(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"),
                                             "o_orderkey")
    return keyed.last_value_by_key(o, "o_orderkey")


@register("key_combine_composite", oracle="""
SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS v
FROM orders GROUP BY 1, 2
""")
def key_combine_composite(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    return keyed.combine_by_key(o, lambda v: {v}, lambda acc, v: acc | {v}, lambda a, b: a | b,
                                k=["status", "year"], v="o_orderpriority", finish=lambda s: ",".join(sorted(s)))


@register("key_aggregate_udf", oracle="""
SELECT l_suppkey AS k, CAST(max(l_linenumber) * 1000000 + count(*) AS BIGINT) AS v FROM lineitem GROUP BY 1
""")
def key_aggregate_udf(spark, sf_dir):
    p = project_keys(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")
    return keyed.aggregate_by_key_with(p, (0, 0), lambda a, v: (max(a[0], v), a[1] + 1),
                                       lambda a, b: (max(a[0], b[0]), a[1] + b[1]),
                                       finish=lambda a: a[0] * 1_000_000 + a[1], out_type="long")
