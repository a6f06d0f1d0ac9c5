"""Registered queries: partition-wise operators and layout.

Partition-dependent outputs are reduced to partition-independent facts
(totals, "every key in one partition") so they can be checked exactly.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.plans.registry import register
from tessera.sources.tables import load

_MASK = (1 << 33) - 1


def _partial_sum(batches):
    total = 0.0
    for b in batches:
        s = pc.sum(b.column("l_quantity")).as_py()
        total += s or 0.0
    yield pa.RecordBatch.from_pydict({"partial": [total]})


@register("part_map", oracle="SELECT sum(l_quantity) AS total_qty FROM lineitem")
def part_map(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_quantity")
    partials = layout.map_partitions(li, _partial_sum, "partial double")
    return partials.agg(F.sum("partial").alias("total_qty"))


def _count_with_index(index, batches):
    n = 0
    for b in batches:
        n += b.num_rows
    yield pa.RecordBatch.from_pydict({"partition": pa.array([index], pa.int32()), "rows": pa.array([n], pa.int64())})


@register("part_map_with_index", oracle="SELECT count(*) AS total_rows, true AS indices_distinct FROM orders")
def part_map_with_index(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    per = layout.map_partitions_with_index(o, _count_with_index, "partition int, rows long")
    return per.agg(F.sum("rows").cast("long").alias("total_rows"),
                   (F.count_distinct("partition") == F.count(F.lit(1))).alias("indices_distinct"))


@register("part_glom", oracle="SELECT count(*) AS total FROM orders")
def part_glom(spark, sf_dir):
    g = layout.glom(load(spark, sf_dir, "orders").select("o_orderkey"))
    return g.agg(F.sum(F.size("rows")).cast("long").alias("total"))


@register("part_profile", oracle="SELECT count(*) AS total_rows FROM lineitem")
def part_profile(spark, sf_dir):
    p = layout.partition_profile(load(spark, sf_dir, "lineitem").select("l_orderkey"))
    return p.agg(F.sum("rows").cast("long").alias("total_rows"))


@register("part_by_key", oracle="""
SELECT count(DISTINCT o_custkey) AS n_keys, true AS one_partition_each FROM orders
""")
def part_by_key(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey")
    p = layout.partition_by(o, 8, "o_custkey").withColumn("pid", F.spark_partition_id())
    per_key = p.groupBy("o_custkey").agg(F.count_distinct("pid").alias("np"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"), (F.max("np") == 1).alias("one_partition_each"))


@register("part_by_custom", oracle="SELECT count(*) AS n_rows, true AS placed_by_function FROM orders")
def part_by_custom(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey")
    p = layout.partition_by_id(o, 8, F.col("o_custkey")).withColumn("pid", F.spark_partition_id())
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.bool_and(F.col("pid") == F.pmod("o_custkey", F.lit(8))).alias("placed_by_function"))


@register("part_sort_within", oracle="""
SELECT CAST(o_orderkey % 4 AS INTEGER) AS partition,
       row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS pos,
       o_orderkey
FROM orders
""")
def part_sort_within(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    s = layout.repartition_and_sort_within(o, 4, F.col("o_orderkey"), ["o_orderkey"])
    mid = F.monotonically_increasing_id()
    s = s.withColumn("__m", mid)
    return s.select(F.shiftright("__m", 33).cast("int").alias("partition"),
                    F.col("__m").bitwiseAND(F.lit(_MASK)).alias("pos"), "o_orderkey")


@register("part_repartition", oracle="SELECT o_orderkey, o_custkey FROM orders")
def part_repartition(spark, sf_dir):
    return layout.repartition(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 5)


@register("part_coalesce", oracle="SELECT o_orderkey, o_custkey FROM orders")
def part_coalesce(spark, sf_dir):
    return layout.coalesce(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 2)
