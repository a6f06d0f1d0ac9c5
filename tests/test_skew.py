"""A key holding a third of all rows: results stay whole and exact, and the
plans split or pre-aggregate the hot group."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, keyed, order
from tessera.plans import wordcount


def _hot(spark, n=30000):
    # one third of the rows share key 0
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                 F.col("id").alias("v"))


def test_skewed_join_is_split_and_exact(spark):
    left = _hot(spark).repartition(8)
    right = spark.range(0, 30000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        j = joins.join(left, right, "k", null_safe=False)
        n = j.count()
        j.collect()
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    want = sum(1 for i in range(30000) if ((0 if i % 3 == 0 else i) % 7 == 0))
    assert n == want
    assert "SortMergeJoin(skew=true)" in plan, plan[:1500]


def test_hot_key_aggregates_are_pre_aggregated(spark):
    df = _hot(spark)
    r = keyed.reduce_by_key(df, "count", "k", "v", out="n")
    assert r.where("k = 0").first()["n"] == 10000
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_word_frequency(spark):
    texts = spark.createDataFrame([("the " * 500 + "cat",)] * 20 + [("a b",)] * 10, "text string")
    f = {r["word"]: r["n"] for r in wordcount.word_frequencies(texts).collect()}
    assert f["the"] == 10000 and f["cat"] == 20 and f["a"] == 10


def test_hot_key_sort_and_group_keep_every_row(spark):
    df = _hot(spark, 3000)
    s = order.sort_by_key(df, ["k"], num_partitions=6)
    sizes = [r[1] for r in s.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 3000  # the 1000 rows of key 0 are split
    g = keyed.group_by_key(df, "k", "v", chunk_rows=250).where("k = 0").collect()
    assert len(g) >= 4 and all(len(r["values"]) <= 250 for r in g)
    assert sorted(x for r in g for x in r["values"]) == list(range(0, 3000, 3))


def test_chunks_hold_every_value_once(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select(
        F.col("o_orderstatus").alias("k"), F.col("o_orderkey").alias("v")).repartition(5)
    got = keyed.group_by_key(o, chunk_rows=1000).collect()
    assert len({(r["k"], r["chunk"]) for r in got}) == len(got)
    assert all(0 < len(r["values"]) <= 1000 and list(r["values"]) == sorted(r["values"]) for r in got)
    assert sorted((r["k"], v) for r in got for v in r["values"]) == sorted(tuple(r) for r in o.collect())


def test_cogroup_chunks_hold_every_value_once(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    a = o.select(F.col("o_orderstatus").alias("k"), F.col("o_orderkey").alias("v"))
    b = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderstatus").alias("k"), F.col("o_custkey").alias("v"))
    got = joins.cogroup([a, b], chunk_rows=1000).collect()
    for side, frame in (("values_0", a), ("values_1", b)):
        assert max(len(r[side]) for r in got) <= 1000
        assert sorted((r["k"], v) for r in got for v in r[side]) == sorted(tuple(r) for r in frame.collect())


def test_hot_key_lies_on_many_tasks_when_grouped(spark):
    df = _hot(spark, 30000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = keyed.group_by_key(df, "k", "v", chunk_rows=200).where("k = 0")
        tasks = g.groupBy(F.spark_partition_id()).agg(F.sum(F.size("values"))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1 and max(r[1] for r in tasks) < 10000


def test_hot_key_is_combined_before_rows_move(spark):
    df = _hot(spark, 30000).repartition(8)
    c = keyed.combine_by_key(df, lambda v: (v, 1), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]),
                             finish=lambda a: a[0] * 100_000 + a[1], out_type="long", fan_in=2)
    plan = c._jdf.queryExecution().executedPlan().toString()
    first_exchange = max(i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(k0" in line)
    assert any("MapInArrow" in line for line in plan.splitlines()[first_exchange + 1:])  # below the first shuffle
    assert "partial_collect_list" in plan
    got = {r["k"]: r["v"] for r in c.collect()}
    assert got[0] == sum(range(0, 30000, 3)) * 100_000 + 10000
    assert len(got) == 20001 and got[1] == 1 * 100_000 + 1


def test_batches_of_a_task_are_combined_at_once(spark):
    """(sum, combiners) of a hot key: one combiner for each task, not for each Arrow batch."""
    df = _hot(spark, 30000).repartition(4)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        c = keyed.combine_by_key(df, lambda v: (v, 1), lambda a, v: (a[0] + v, a[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]),
                                 finish=lambda a: a[0] * 1000 + a[1], out_type="long", fan_in=2)
        got = {r["k"]: r["v"] for r in c.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got[0] // 1000 == sum(range(0, 30000, 3)) and got[0] % 1000 == 4
    assert len(got) == 20001 and got[1] == 1001


def test_batches_are_joined_up_to_a_bound():
    rows = keyed.TOGETHER_ROWS // 2
    batch = pa.RecordBatch.from_arrays([pa.nulls(rows, pa.null())], ["v"])
    assert [b.num_rows for b in keyed._together(iter([batch] * 5))] == [2 * rows, 2 * rows, rows]
    wide = pa.RecordBatch.from_arrays([pa.array(["x" * keyed.TOGETHER_BYTES])], ["v"])
    assert [b.num_rows for b in keyed._together(iter([wide] * 3))] == [1, 1, 1]
    assert [*keyed._together(iter([]))] == []


def test_combine_by_key_of_any_key_type(spark):
    t = "timestamp_ntz '2024-01-01 00:00:00.000001'"
    rows = spark.sql(f"""SELECT * FROM VALUES (array(1, null), {t}, 1), (array(1, null), {t}, 2), (array(1), {t}, 4),
        (null, {t}, 8), (array(), {t}, 16), (array(), timestamp_ntz '2024-01-01 00:00:00.000002', 32), (array(), null, 64) AS x(k, t, v)""")
    rows = rows.withColumn("s", F.struct("t", F.lit(1.5).alias("x")))
    one = lambda **a: sorted(r["v"] for r in keyed.combine_by_key(rows, int, int.__add__, int.__add__, out_type="long", **a).collect())
    assert one(k="k") == [3, 4, 8, 112]
    assert one(k=["k", "t"]) == one(k=["k", "s"]) == [3, 4, 8, 16, 32, 64]
    assert one(k="t") == one(k="s") == [31, 32, 64]


@pytest.mark.parametrize("value", ["CAST(NULL AS LONG)", "7L", "IF(id % 2 = 0, NULL, id % 5)"])
def test_hot_key_of_equal_values_lies_on_many_tasks(spark, value):
    df = spark.range(30000).selectExpr("IF(id % 3 = 0, 0, id) AS k", f"{value} AS v")
    want = sorted((r["v"] for r in df.where("k = 0").collect()), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = keyed.group_by_key(df, "k", "v", chunk_rows=200)
        got = g.where("k = 0").withColumn("task", F.spark_partition_id()).collect()
        assert g.where("k != 0 and (chunk != 0 or size(values) != 1)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((x for r in got for x in r["values"]), key=str) == want
    assert all(0 < len(r["values"]) <= 200 for r in got) and len({r["chunk"] for r in got}) == len(got)
    per_task = {}
    for r in got:
        per_task[r["task"]] = per_task.get(r["task"], 0) + len(r["values"])
    assert len(got) <= 10000 / 200 + 12 and len(per_task) >= 6 and max(per_task.values()) < 4000


def test_cogroup_of_repeated_values_on_both_sides(spark):
    a = spark.range(900).selectExpr("id % 2 AS k", "IF(id % 3 = 0, NULL, 'x') AS v")
    b = spark.range(50).selectExpr("CAST(NULL AS LONG) AS k", "'y' AS v").union(spark.range(40).selectExpr("1L AS k", "string(id) AS v"))
    got = joins.cogroup([a, b], chunk_rows=20).collect()
    for side, frame in (("values_0", a), ("values_1", b)):
        assert all(len(r[side]) <= 20 for r in got)
        assert sorted(((r["k"], v) for r in got for v in r[side]), key=str) == sorted(map(tuple, frame.collect()), key=str)
    assert len({(r["k"], r["chunk"]) for r in got}) == len(got)


_SPREAD = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2k",  # the hot keys only
           "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("hot_side", ["left", "right", "both", "alone", "null"])
def test_outer_join_splits_a_hot_key_on_either_side(spark, how, hot_side):
    key = "CAST(NULL AS LONG)" if hot_side == "null" else "0L"
    hot = spark.range(9000).selectExpr(f"IF(id % 3 = 0, {key}, id) AS k", "id AS v").repartition(6)
    other = spark.range(0, 9000, 7).selectExpr("IF(id = 0, NULL, id) AS k" if hot_side in ("alone", "null") else "id AS k", "id * 2 AS v")
    if hot_side == "both":
        hot = spark.range(1200).selectExpr("IF(id % 3 = 0, 0L, id) AS k", "id AS v").repartition(6)
        other = other.union(spark.range(50).selectExpr("0L AS k", "-id AS v"))
    a, b = (other, hot) if hot_side == "right" else (hot, other)
    old = {k: spark.conf.get(k, None) for k in _SPREAD}
    for k, v in _SPREAD.items():
        spark.conf.set(k, v)
    try:
        plain = joins.join(a, b, "k", how, hot_rows=None)
        j = joins.join(a, b, "k", how, hot_rows=20 if hot_side == "both" else 60)
        assert j.columns == plain.columns and j.dtypes == plain.dtypes
        want = sorted(map(tuple, plain.collect()), key=str)
        assert sorted(map(tuple, j.collect()), key=str) == want
        tasks = [r[1] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        kept = [r[1] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # a third of the rows or more share the key; a full join leaves it whole without the split
    assert max(tasks) < 0.2 * len(want), tasks
    assert how != "full" or max(kept) > 0.3 * len(want)


def test_outer_join_of_plain_keys_leaves_null_keys_alone(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "k long, v long")
    b = spark.createDataFrame([(None, 5), (1, 6), (1, 7), (3, 8)], "k long, w long")
    for how in ("left", "right", "full"):
        for null_safe in (True, False):
            got = joins.join(a, b, "k", how, null_safe=null_safe, hot_rows=1).collect()
            want = joins.join(a, b, "k", how, null_safe=null_safe, hot_rows=None).collect()
            assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
