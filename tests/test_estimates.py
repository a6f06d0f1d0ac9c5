"""Progressive estimates, kept sketches and lookups that read one bucket."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout, rows, sampling


def _blocks(seed, n=200):
    rng = random.Random(seed)
    return [(k := rng.randint(80, 120), sum(rng.expovariate(0.01) for _ in range(k))) for _ in range(n)]


@pytest.mark.parametrize("read", [12, 40])
def test_bounds_hold_the_total_as_often_as_they_say(read):
    blocks = _blocks(1)
    rows_, sums = sum(b[0] for b in blocks), sum(b[1] for b in blocks)
    exact = {"count": rows_, "sum": sums, "mean": sums / rows_}
    for name, x in exact.items():
        hits = 0
        for seed in range(300):
            _, low, high = sampling.block_estimates(random.Random(seed).sample(blocks, read), len(blocks), 0.95)[name]
            hits += low <= x <= high
        assert hits / 300 >= 0.91, (name, hits)  # 0.95 less three standard deviations of 300 trials


def test_all_blocks_give_the_exact_answer():
    blocks = _blocks(2, 30)
    for name, (x, low, high) in sampling.block_estimates(blocks, 30).items():
        assert low == high == x, name
    assert sampling.block_estimates(blocks, 30)["count"][0] == sum(b[0] for b in blocks)


def test_progressive_estimate_reads_some_blocks_only(spark):
    df = spark.range(0, 64_000, numPartitions=64).select((F.col("id") % 100).alias("x"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    r = sampling.progressive_estimate(df.mapInArrow(count, "x long"), "x", "mean", 0.05, first=8).first()
    assert (r["blocks"], r["blocks_read"]) == (64, 8) and seen.value == 8000
    assert r["mean_low"] <= 49.5 <= r["mean_high"] and r["count_mean"] == 64_000
    again = sampling.progressive_estimate(df, "x", "mean", 0.05, first=8).first()
    assert tuple(again) == tuple(r)
    whole = sampling.progressive_estimate(df, "x", "sum", 0.0, first=8).first()
    assert whole["blocks_read"] <= 64 and whole["sum_low"] <= 49.5 * 64_000 <= whole["sum_high"]


def test_progressive_estimate_stops_when_time_is_over(spark):
    df = spark.range(0, 3200, numPartitions=32).select((F.col("id") * F.col("id") % 1009).alias("x"))
    ticks = iter(range(100))
    r = sampling.progressive_estimate(df, "x", "sum", 1e-9, first=4, seconds=2, clock=lambda: next(ticks)).first()
    assert 4 < r["blocks_read"] < 32
    whole = sampling.progressive_estimate(df, "x", "sum", 1e-9, first=4).first()
    assert whole["blocks_read"] == 32 and whole["sum_low"] == whole["sum_high"] == sum(i * i % 1009 for i in range(3200))


def test_progressive_estimate_of_nulls_and_nothing(spark):
    nulls = spark.range(0, 40, numPartitions=4).select(F.lit(None).cast("long").alias("x"))
    r = sampling.progressive_estimate(nulls, "x").first()
    assert (r["count_mean"], r["sum_mean"], r["mean_mean"]) == (40, 0, 0)
    empty = spark.createDataFrame([], "x long")
    assert sampling.progressive_estimate(empty, "x").first()["count_mean"] == 0


def test_merged_sketches_equal_that_of_all_rows(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 12_000).alias("x"), (F.col("id") % 13).alias("batch"))
    parts = sampling.distinct_sketches(df, "x", ["batch"])
    whole = sampling.merged_distinct(sampling.distinct_sketches(df, "x")).first()[0]
    assert parts.count() == 13 and sampling.merged_distinct(parts).first()[0] == whole
    assert abs(whole - 12_000) <= 3 * 1.04 / 64 * 12_000
    again = sampling.merged_distinct(parts.unionByName(parts)).first()[0]
    assert again == whole  # values in several sketches count once


def test_lookup_reads_one_bucket(spark):
    pairs = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    table = layout.write_bucketed(pairs, "lookup_pairs", 16, "k")
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    old = spark.conf.get(auto)
    spark.conf.set(auto, "false")  # the plan names the buckets of such scans only; others skip the files too
    try:
        found = rows.lookup(table, 42)
        plan = found._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.set(auto, old)
    assert "SelectedBucketsCount: 1 out of 16" in plan, plan
    assert sorted(r["v"] for r in found.collect()) == list(range(42, 1000, 100))
