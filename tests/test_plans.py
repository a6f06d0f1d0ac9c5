"""Physical-plan properties the operators promise (checked on executed,
adaptive plans at sf0.001)."""

import pytest

import __spark_entry__ as ent
from tessera.operators import position
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q():
    return ent.queries()


def test_filter_pushed_into_scan(spark, q):
    p = executed_plan(q["row_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in p


def test_columns_pruned(spark, q):
    p = executed_plan(q["join_inner"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "o_totalprice" not in p


def test_partial_aggregation_before_shuffle(spark, q):
    for key in ("wc_frequencies", "key_reduce_sum", "agg_count_by_value"):
        p = executed_plan(q[key](spark, SF))
        assert "partial_" in p, key


def test_top_k_is_bounded_heap(spark, q):
    df = q["top_n"](spark, SF)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_dense_index_shares_one_range_layout(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    p = executed_plan(position.row_index(df, ["o_orderkey"]))
    assert p.count("Scan parquet") >= 2 and "rangepartitioning" not in p  # both branches scan the one written layout
    assert "Window" in p  # only over the per-partition counts
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_sql_kmeans_stays_in_the_jvm(spark, q):
    p = executed_plan(q["kmeans_assign"](spark, SF))
    for python_node in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "PythonMapInArrow"):
        assert python_node not in p


def test_word_count_totals_have_no_python_and_no_regex_for_tokens(spark, q):
    p = executed_plan(q["wc_split_tokens"](spark, SF))
    assert "EvalPython" not in p and "regexp" not in p.lower()


def test_hash_sample_is_a_filter(spark, q):
    p = executed_plan(q["sample_hash"](spark, SF))
    assert "Exchange" not in p and "md5" in p


def test_dense_index_survives_downstream_pruning(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    for _ in range(2):
        r = position.row_index(df, ["o_orderkey"], num_partitions=8).select("idx", "o_orderkey")
        got = {row["o_orderkey"]: row["idx"] for row in r.collect()}
        keys = sorted(got)
        assert [got[k] for k in keys] == list(range(len(keys)))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_dense_index_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey")
        r = position.row_index(df, ["o_orderkey"], num_partitions=8)
        got = {row["o_orderkey"]: row["idx"] for row in r.collect()}
        keys = sorted(got)
        assert [got[k] for k in keys] == list(range(len(keys)))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_bucketed_join_has_no_exchange(spark, q):
    df = q["join_bucketed"](spark, SF)
    p = executed_plan(df)
    final = p.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final or "BroadcastHashJoin" in final
    if "SortMergeJoin" in final:
        assert "Exchange" not in final


#: Queries whose building runs jobs of its own, and why.
EAGER = {
    "sink_", "act_",  # sinks and actions: they write or look before there is a result
    "src_read_",  # text files are written before they are read back
    "kmeans_",  # rounds, and the fixed starting centres
    "agg_histogram_even",  # the range of the column
    "is_empty",  # an action
    "sort_", "zip_",  # dense index: the sorted ranges are written once
    "take_sample_repl",  # the size, and the dense index
    "join_bucketed", "row_lookup_bucketed",  # the tables are written bucketed
    "approx_progressive",  # reads blocks until the estimate is good enough
    "sketch_distinct_merged",  # the sketches are stored, then merged
    "op", "pipeline",  # multi-pass operators write their intermediate tables
}


def test_building_a_query_runs_no_job(spark, q):
    tracker = spark.sparkContext.statusTracker()
    before = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in TABLES}
    assert before
    for key, build in q.items():
        if key.startswith(tuple(EAGER)):
            continue
        spark.sparkContext.setJobGroup(f"build-{key}", key)
        try:
            build(spark, SF)
            jobs = tracker.getJobIdsForGroup(f"build-{key}")
        finally:
            spark.sparkContext.setJobGroup("", "")
        assert len(jobs) <= SCHEMA_READS.get(key, 4), (key, len(jobs))


#: A parquet schema read per table; no query outside EAGER loads more than four.
SCHEMA_READS: dict[str, int] = {}
