"""Registered queries: whole-dataset aggregation and histograms.

Money is summed as decimal(18,2) and floating statistics are rounded to 6
places on both sides, so the check is exact and not summation-order noise.
"""

from __future__ import annotations

import operator

from pyspark.sql import functions as F

from tessera.operators import agg, histogram
from tessera.plans.registry import register
from tessera.sources.tables import load


def _r6(c):
    return F.round(c, 6)


@register("agg_reduce_sum", oracle="SELECT sum(l_quantity) AS value FROM lineitem")
def agg_reduce_sum(spark, sf_dir):
    return agg.reduce(load(spark, sf_dir, "lineitem"), "l_quantity", "sum")


@register("agg_reduce_udf", oracle="SELECT CAST(bit_xor(o_orderkey) AS BIGINT) AS value FROM orders")
def agg_reduce_udf(spark, sf_dir):
    # any commutative, associative Python function: here XOR
    return agg.reduce_with(load(spark, sf_dir, "orders"), "o_orderkey", operator.xor, "value long")


@register("agg_tree_reduce", oracle="SELECT CAST(sum(user_id) AS BIGINT) AS value FROM events")
def agg_tree_reduce(spark, sf_dir):
    return agg.tree_reduce(load(spark, sf_dir, "events"), "user_id", "sum", fan_in=2)


@register("agg_fold", oracle="SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS value FROM orders")
def agg_fold(spark, sf_dir):
    return agg.fold(load(spark, sf_dir, "orders"), "o_custkey", 0, "sum")


@register("agg_aggregate_sum_count", oracle="""
SELECT coalesce(sum(l_quantity), 0) AS sum, count(*) AS count FROM lineitem
""")
def agg_aggregate_sum_count(spark, sf_dir):
    return agg.aggregate_sum_count(load(spark, sf_dir, "lineitem"), "l_quantity")


@register("agg_aggregate_udf", oracle="""
SELECT CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) AS n_texts FROM documents
""")
def agg_aggregate_udf(spark, sf_dir):
    # (zero, seqOp, combOp) with Python functions: (chars, texts)
    return agg.aggregate_with(
        load(spark, sf_dir, "documents"), "text", (0, 0),
        lambda acc, t: (acc[0] + len(t), acc[1] + 1),
        lambda a, b: (a[0] + b[0], a[1] + b[1]),
        "total_chars long, n_texts long")


@register("agg_tree_aggregate", oracle="""
SELECT CAST(sum(user_id) AS BIGINT) AS sum, count(*) AS count FROM events
""")
def agg_tree_aggregate(spark, sf_dir):
    return agg.tree_aggregate_sum_count(load(spark, sf_dir, "events"), "user_id", fan_in=2)


@register("agg_max", oracle="SELECT max(o_totalprice) AS max FROM orders")
def agg_max(spark, sf_dir):
    return agg.max_value(load(spark, sf_dir, "orders"), "o_totalprice")


@register("agg_min", oracle="SELECT min(o_totalprice) AS min FROM orders")
def agg_min(spark, sf_dir):
    return agg.min_value(load(spark, sf_dir, "orders"), "o_totalprice")


@register("agg_argmax", oracle="""
SELECT o_orderkey AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1
""")
def agg_argmax(spark, sf_dir):
    return agg.arg_max(load(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice"))


@register("agg_argmin", oracle="""
SELECT p_partkey AS value FROM part ORDER BY p_name, p_partkey LIMIT 1
""")
def agg_argmin(spark, sf_dir):
    # minimum by a text key, as min(key=str)
    return agg.arg_min(load(spark, sf_dir, "part"), "p_partkey", F.col("p_name"))


@register("agg_sum", oracle="""
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM lineitem
""")
def agg_sum(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return agg.sum_value(li, F.col("l_extendedprice").cast("decimal(18,2)")).select(
        F.col("sum").cast("double").alias("sum"))


@register("agg_count", oracle="SELECT count(*) AS count FROM lineitem")
def agg_count(spark, sf_dir):
    return agg.count_rows(load(spark, sf_dir, "lineitem"))


@register("agg_stats", oracle="""
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(sum(value), 6) AS sum,
       min(value) AS min, max(value) AS max,
       round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stdev,
       round(var_samp(value), 6) AS sample_variance, round(stddev_samp(value), 6) AS sample_stdev
FROM events
""")
def agg_stats(spark, sf_dir):
    s = agg.stats(load(spark, sf_dir, "events"), "value")
    return s.select("count", _r6("mean").alias("mean"), _r6("sum").alias("sum"), "min", "max",
                    *[_r6(c).alias(c) for c in ("variance", "stdev", "sample_variance", "sample_stdev")])


@register("agg_mean", oracle="SELECT round(avg(value), 6) AS mean FROM events")
def agg_mean(spark, sf_dir):
    return agg.mean(load(spark, sf_dir, "events"), "value").select(_r6("mean").alias("mean"))


@register("agg_var_pop", oracle="SELECT round(var_pop(value), 6) AS variance FROM events")
def agg_var_pop(spark, sf_dir):
    return agg.variance(load(spark, sf_dir, "events"), "value").select(_r6("variance").alias("variance"))


@register("agg_stddev_pop", oracle="SELECT round(stddev_pop(value), 6) AS stdev FROM events")
def agg_stddev_pop(spark, sf_dir):
    return agg.stdev(load(spark, sf_dir, "events"), "value").select(_r6("stdev").alias("stdev"))


@register("agg_stddev_samp", oracle="SELECT round(stddev_samp(value), 6) AS sample_stdev FROM events")
def agg_stddev_samp(spark, sf_dir):
    return agg.sample_stdev(load(spark, sf_dir, "events"), "value").select(
        _r6("sample_stdev").alias("sample_stdev"))


@register("agg_var_samp", oracle="SELECT round(var_samp(value), 6) AS sample_variance FROM events")
def agg_var_samp(spark, sf_dir):
    return agg.sample_variance(load(spark, sf_dir, "events"), "value").select(
        _r6("sample_variance").alias("sample_variance"))


@register("agg_count_by_value", oracle="""
SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL
""")
def agg_count_by_value(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return agg.count_by_value(li)


@register("agg_map_reduce_sum", oracle="""
SELECT CAST(sum(l_quantity * l_quantity) AS BIGINT) AS value FROM lineitem
""")
def agg_map_reduce_sum(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"))
    return agg.map_reduce_expr(li, "x * x", "sum", "bigint")


@register("agg_map_reduce_product", oracle="""
SELECT round(product(1 + l_discount / 1000), 6) AS value FROM lineitem
""")
def agg_map_reduce_product(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x"))
    return agg.map_reduce_expr(li, "1 + x / 1000", "product").select(_r6("value").alias("value"))


# ---------------------------------------------------------------- histograms

@register("agg_histogram_even", oracle="""
WITH mm AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS inc
            FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT CAST(least(floor((value - lo) / inc), 9) AS INTEGER) AS bucket, count(*) AS n
      FROM events, mm WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1),
b AS (SELECT CAST(i AS INTEGER) AS bucket, i * inc + lo AS low,
             CASE WHEN i = 9 THEN hi ELSE (i + 1) * inc + lo END AS high
      FROM range(10) t(i), mm)
SELECT b.bucket, b.low, b.high, coalesce(c.n, 0) AS count FROM b LEFT JOIN c USING (bucket)
""")
def agg_histogram_even(spark, sf_dir):
    return histogram.histogram_even(load(spark, sf_dir, "events"), "value", 10)


EDGES = [0.0, 5.0, 25.0, 50.0, 100.0, 500.0]


@register("agg_histogram_edges", oracle="""
WITH c AS (
  SELECT CASE WHEN value < 5 THEN 0 WHEN value < 25 THEN 1 WHEN value < 50 THEN 2
              WHEN value < 100 THEN 3 ELSE 4 END AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND value <= 500 GROUP BY 1),
b AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 5.0, 25.0), (2, 25.0, 50.0), (3, 50.0, 100.0), (4, 100.0, 500.0))
      t(bucket, low, high))
SELECT CAST(b.bucket AS INTEGER) AS bucket, CAST(b.low AS DOUBLE) AS low, CAST(b.high AS DOUBLE) AS high,
       coalesce(c.n, 0) AS count
FROM b LEFT JOIN c USING (bucket)
""")
def agg_histogram_edges(spark, sf_dir):
    return histogram.histogram_edges(load(spark, sf_dir, "events"), "value", EDGES)


STRING_EDGES = ["A", "C", "H", "M", "N"]


@register("agg_histogram_strings", oracle="""
WITH c AS (
  SELECT CASE WHEN c_mktsegment < 'C' THEN 0 WHEN c_mktsegment < 'H' THEN 1
              WHEN c_mktsegment < 'M' THEN 2 ELSE 3 END AS bucket, count(*) AS n
  FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment >= 'A' AND c_mktsegment <= 'N' GROUP BY 1),
b AS (SELECT * FROM (VALUES (0, 'A', 'C'), (1, 'C', 'H'), (2, 'H', 'M'), (3, 'M', 'N')) t(bucket, low, high))
SELECT CAST(b.bucket AS INTEGER) AS bucket, b.low, b.high, coalesce(c.n, 0) AS count
FROM b LEFT JOIN c USING (bucket)
""")
def agg_histogram_strings(spark, sf_dir):
    return histogram.histogram_edges(load(spark, sf_dir, "customer"), "c_mktsegment", STRING_EDGES)


@register("agg_tree_reduce_udf", oracle="""
SELECT max(l_orderkey * 10 + l_linenumber) AS value FROM lineitem
""")
def agg_tree_reduce_udf(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("x"))
    return agg.reduce_with(li, "x", max, "value long", depth=3, fan_in=4)


@register("agg_tree_aggregate_udf", oracle="""
SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n, max(l_linenumber) AS hi FROM lineitem
""")
def agg_tree_aggregate_udf(spark, sf_dir):
    return agg.aggregate_with(load(spark, sf_dir, "lineitem"), "l_linenumber", (0, 0, 0),
                              lambda a, x: (a[0] + x, a[1] + 1, max(a[2], x)),
                              lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])),
                              "total long, n long, hi int", depth=3, fan_in=4)
