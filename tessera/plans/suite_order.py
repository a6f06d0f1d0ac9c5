"""Registered queries: sorting, limits, top-k.

Sorted outputs carry their global position ``idx`` so the check verifies the
order itself, not just the multiset. Ties are broken by a second key on
both sides (the original leaves the order of equal keys unspecified).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import order
from tessera.plans.registry import register
from tessera.sources.tables import load


@register("sort_by_key", oracle="""
SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx, o_orderkey, o_totalprice FROM orders
""")
def sort_by_key(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return order.ranked(o, ["o_totalprice", "o_orderkey"])


@register("sort_by_key_desc", oracle="""
SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS idx, o_orderkey, o_totalprice
FROM orders
""")
def sort_by_key_desc(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return order.ranked(o, ["o_totalprice", "o_orderkey"], ascending=False)


@register("sort_by_lower", oracle="""
SELECT row_number() OVER (ORDER BY lower(c_name), c_custkey) - 1 AS idx, c_custkey, c_name FROM customer
""")
def sort_by_lower(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return order.ranked(c, [F.lower("c_name"), F.col("c_custkey")])


@register("sort_by_expr", oracle="""
SELECT row_number() OVER (ORDER BY -value, event_id) - 1 AS idx, event_id, value FROM events
""")
def sort_by_expr(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value")
    return order.ranked(e, [-F.col("value"), F.col("event_id")])


@register("top_n", oracle="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10
""")
def top_n(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return order.top(o, 10, ["o_totalprice", "o_orderkey"])


@register("top_n_by_key", oracle="""
SELECT p_partkey, p_name FROM part ORDER BY length(p_name) DESC, p_partkey DESC LIMIT 5
""")
def top_n_by_key(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return order.top(p, 5, [F.length("p_name"), F.col("p_partkey")])


@register("take_ordered", oracle="""
SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10
""")
def take_ordered(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value")
    return order.take_ordered(e, 10, ["value", "event_id"])


@register("take_n", oracle="SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS n_distinct, true AS all_exist")
def take_n(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id")
    t = order.take(e, 10)
    found = t.join(e.select("event_id").withColumn("__hit", F.lit(1)), "event_id", "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct"),
                     F.bool_and(F.col("__hit").isNotNull()).alias("all_exist"))


@register("first_row", oracle="SELECT event_id, value FROM events ORDER BY event_id LIMIT 1")
def first_row(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value")
    return order.first(e, ["event_id"])


@register("is_empty", oracle="""
SELECT (SELECT count(*) = 0 FROM orders WHERE o_totalprice < 0) AS is_empty
""")
def is_empty(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return order.is_empty(o.where(F.col("o_totalprice") < 0))


@register("sort_float64", oracle="""
SELECT row_number() OVER (ORDER BY CAST(l_extendedprice AS DOUBLE)) - 1 AS idx,
       CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem
""")
def sort_float64(spark, sf_dir):
    return order.sort_values(load(spark, sf_dir, "lineitem"), "l_extendedprice", index_col="idx")


_I32 = "CAST(trunc({c}) AS INTEGER)"
_F32 = "CAST(CAST({c} AS FLOAT) AS DOUBLE)"


def _pairs_sql(fmt: str, desc: bool) -> str:
    k, v = fmt.format(c="l_extendedprice"), fmt.format(c="l_quantity")
    d = " DESC" if desc else ""
    return f"""
SELECT row_number() OVER (ORDER BY k{d}, v{d}) - 1 AS idx, k, v
FROM (SELECT {k} AS k, {v} AS v FROM lineitem)
"""


def _pairs(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("k"), F.col("l_quantity").alias("v"))


@register("sort_int32_by_key", oracle=_pairs_sql(_I32, False))
def sort_int32_by_key(spark, sf_dir):
    return order.sort_int32_by_key(_pairs(spark, sf_dir), index_col="idx", then_by_value=True)


@register("sort_int32_by_key_desc", oracle=_pairs_sql(_I32, True))
def sort_int32_by_key_desc(spark, sf_dir):
    return order.sort_int32_by_key(_pairs(spark, sf_dir), descending=True, index_col="idx", then_by_value=True)


@register("sort_float32_by_key", oracle=_pairs_sql(_F32, False))
def sort_float32_by_key(spark, sf_dir):
    return order.sort_float32_by_key(_pairs(spark, sf_dir), index_col="idx", then_by_value=True)


@register("sort_float32_by_key_desc", oracle=_pairs_sql(_F32, True))
def sort_float32_by_key_desc(spark, sf_dir):
    return order.sort_float32_by_key(_pairs(spark, sf_dir), descending=True, index_col="idx", then_by_value=True)


@register("sort_range_partitioned", oracle=_pairs_sql(_F32, False))
def sort_range_partitioned(spark, sf_dir):
    return order.sort_range_partitioned(_pairs(spark, sf_dir), 8, index_col="idx", then_by_value=True)


def _in_order(df, key):
    """Rows, and neighbours across the partitions' ends that are out of order."""
    places = df.select(F.col(key).alias("k")).withColumn("p", F.monotonically_increasing_id())
    pid = F.shiftright("p", 33)
    inside = places.withColumn("before", F.lag("k").over(Window.partitionBy(pid).orderBy("p")))
    wrong = F.sum(F.when(F.col("before") > F.col("k"), 1).otherwise(0))
    ends = inside.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    ends = ends.withColumn("before", F.lag("hi").over(Window.orderBy("pid")))  # one row for each partition
    return ends.agg(F.sum("n").alias("n"), F.sum(F.col("wrong") + F.when(F.col("before") > F.col("lo"), 1).otherwise(0)).alias("out_of_order"),
                    F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@register("sort_by_key_plain", oracle="""
SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders
""")
def sort_by_key_plain(spark, sf_dir):
    return _in_order(order.sort_by_key(load(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice"), "o_totalprice")


@register("sort_by_plain", oracle="""
SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order, min(v) AS lo, max(v) AS hi FROM (SELECT -value AS v FROM events)
""")
def sort_by_plain(spark, sf_dir):
    e = load(spark, sf_dir, "events").select((-F.col("value")).alias("v"))
    return _in_order(order.sort_by(e, "v"), "v")
