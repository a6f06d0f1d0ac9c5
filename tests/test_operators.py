"""Operators on small inline frames: their results against plain Python, and
the semantic rules (nulls, duplicates, ties, empty input) one by one."""

import operator
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import agg, histogram, joins, keyed, layout, order, position, rows, sampling, sets
from tests.conftest import rows as R

RND = random.Random(20)
NUMBERS = [RND.randint(-40, 40) for _ in range(60)]


def ints(spark, values, n=1, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long").repartition(n) if n > 1 else \
        spark.createDataFrame([(v,) for v in values], f"{name} long").coalesce(1)


def pairs(spark, data, vtype="long"):
    return spark.createDataFrame(data, f"k string, v {vtype}")


# ---------------------------------------------------------------- rows

def test_map_flat_map_filter(spark):
    d = ints(spark, NUMBERS, 3)
    assert Counter(map(tuple, rows.map_rows(d, F.col("x"), (F.col("x") % 7).alias("r")).collect())) == \
        Counter((x, int(__import__("math").fmod(x, 7))) for x in NUMBERS)
    small = [x for x in NUMBERS if 0 < x < 9]
    fm = rows.flat_map(ints(spark, small), F.sequence(F.lit(1), F.col("x")), "y")
    assert Counter(r[0] for r in fm.collect()) == Counter(y for x in small for y in range(1, x + 1))
    assert Counter(r[0] for r in rows.filter_rows(d, "x < -3").collect()) == Counter(x for x in NUMBERS if x < -3)


def test_pair_helpers(spark):
    p = spark.createDataFrame([(10, -1), (20, -2), (20, None)], "k long, v long")
    assert R(rows.keys(p)) == [(10,), (20,), (20,)]
    assert Counter(r[0] for r in rows.values(p).collect()) == Counter([-1, -2, None])
    lists = spark.createDataFrame([("north", ["oak", "elm"]), ("south", []), ("west", ["fir"])], "k string, v array<string>")
    assert R(rows.flat_map_values(lists, "v")) == [("north", "elm"), ("north", "oak"), ("west", "fir")]
    assert R(rows.map_values(lists, F.size("v"))) == [("north", 2), ("south", 0), ("west", 1)]


def test_lookup(spark):
    p = spark.createDataFrame([(i % 100, i) for i in range(300)] + [(None, -1)], "k long, v long").repartition(6)
    assert sorted(r[0] for r in rows.lookup(p, 17).collect()) == [17, 117, 217]
    assert rows.lookup(p, 100).collect() == []
    assert [r[0] for r in rows.lookup(p, None).collect()] == [-1]


def test_vector_map_and_map_reduce(spark):
    d = ints(spark, NUMBERS, 4)
    assert agg.map_reduce_expr(d, "x * x + 1", "sum").first()[0] == sum(x * x + 1 for x in NUMBERS)
    assert Counter(r[0] for r in rows.vector_map(d, "x", "x * 3 - 1").collect()) == Counter(x * 3 - 1 for x in NUMBERS)


def test_pipe_keeps_empty_lines_and_takes_quoted_commands(spark):
    lines = ["a b c", "", "b a b"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    assert [r[0] for r in rows.pipe(df, ["cat"]).collect()] == lines
    assert [r[0] for r in rows.pipe(df, "sed 's/a b/X/'").collect()] == ["X c", "", "b X"]


def test_pipe_failure_raises(spark):
    df = spark.createDataFrame([("1",)], "value string")
    with pytest.raises(Exception):
        rows.pipe(df, ["false"]).collect()


# ---------------------------------------------------------------- layout

def test_map_partitions_and_glom(spark):
    df = ints(spark, NUMBERS).repartitionByRange(3, "x")

    def sums(batches):
        yield pa.RecordBatch.from_pydict({"s": [sum(x for b in batches for x in b.column("x").to_pylist())]})

    parts = sorted((r["partition"], [x["x"] for x in r["rows"]]) for r in layout.glom(df).collect())
    assert sorted(x for _, p in parts for x in p) == sorted(NUMBERS)
    assert all(max(a) <= min(b) for (_, a), (_, b) in zip(parts, parts[1:]) if a and b)
    assert sorted(r[0] for r in layout.map_partitions(df, sums, "s long").collect()) == sorted(sum(p) for _, p in parts)
    assert layout.num_partitions(df) == len(parts) == 3
    assert "Exchange SinglePartition" not in layout.glom(df)._jdf.queryExecution().toString()
    assert [list(r["rows"]) for r in layout.glom(spark.range(5).where("id > 9").coalesce(1)).collect()] == [[]]


def test_partition_by_puts_each_key_in_one_partition(spark):
    df = spark.createDataFrame([(x % 6, x) for x in NUMBERS], "k long, v long")
    p = layout.partition_by(df, 2, "k").withColumn("pid", F.spark_partition_id())
    assert all(r[1] == 1 for r in p.groupBy("k").agg(F.count_distinct("pid")).collect())


def test_repartition_and_sort_within(spark):
    df = spark.createDataFrame([(abs(x) % 5, x) for x in NUMBERS], "k long, v long")
    s = layout.repartition_and_sort_within(df, 2, F.col("k"), ["k"])
    parts = {r["partition"]: [x["k"] for x in r["rows"]] for r in layout.glom(s).collect()}
    want = Counter(abs(x) % 5 for x in NUMBERS)
    assert parts == {p: sorted(k for k in want.elements() if k % 2 == p) for p in (0, 1)}


def test_repartition_coalesce(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "x long").repartition(4)
    assert layout.num_partitions(layout.repartition(df, 2)) == 2
    assert layout.num_partitions(layout.repartition(df, 10)) == 10
    c = layout.coalesce(spark.createDataFrame([(i,) for i in range(1, 6)], "x long").repartition(3), 1)
    assert layout.num_partitions(c) == 1 and sorted(r[0] for r in c.collect()) == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- joins

def test_joins_against_python(spark):
    left = [(f"k{x % 9}", x) for x in NUMBERS[:20]]
    right = [(f"k{x % 9 + 3}", x) for x in NUMBERS[20:35]]
    a, b = pairs(spark, left), spark.createDataFrame(right, "k string, w long")
    both = [(k, v, w) for k, v in left for j, w in right if k == j]
    only_left = [(k, v, None) for k, v in left if k not in dict(right)]
    only_right = [(k, None, w) for k, w in right if k not in dict(left)]
    for how, want in (("inner", both), ("left", both + only_left), ("right", both + only_right), ("full", both + only_left + only_right)):
        assert Counter(map(tuple, joins.join(a, b, "k", how).select("k", "v", "w").collect())) == Counter(want)


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v long")
    b = spark.createDataFrame([(None, 10), ("a", 20), ("c", None)], "k string, w long")
    assert len(joins.join(a, b, "k").collect()) == 2
    assert len(joins.join(a, b, "k", "full").collect()) == 4
    assert R(joins.subtract_by_key(a, b, "k")) == [("b", 3)]


def test_subtract_keeps_duplicates(spark):
    a, b = NUMBERS, NUMBERS[::3]
    assert Counter(r[0] for r in sets.subtract(ints(spark, a, 3), ints(spark, b)).collect()) == Counter(x for x in a if x not in b)
    rows_a = [(f"k{x % 4}", x) for x in NUMBERS[:20]] * 2
    gone = [("k1", None), ("k2", 7)]
    got = joins.subtract_by_key(pairs(spark, rows_a), pairs(spark, gone), "k")
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows_a if r[0] not in ("k1", "k2"))


def test_cartesian(spark):
    a, b = [1, 1, 5], [-1, None]
    got = joins.cartesian(ints(spark, a), ints(spark, b)).collect()
    assert Counter(map(tuple, got)) == Counter((x, y) for x in a for y in b)


def test_cogroup_against_python(spark):
    data = [[(f"k{x % m}", x) for x in NUMBERS[i * 12 : i * 12 + 12]] for i, m in enumerate((5, 3, 7, 2))]
    for n in (2, 4):
        got = joins.cogroup([pairs(spark, d) for d in data[:n]], chunk_rows=100).collect()
        keys = {k for d in data[:n] for k, _ in d}
        assert {r["k"]: [sorted(r[f"values_{i}"]) for i in range(n)] for r in got} == \
            {k: [sorted(v for j, v in d if j == k) for d in data[:n]] for k in keys}
        assert all(r["chunk"] == 0 for r in got) and len(got) == len(keys)


def test_hot_key_is_split_into_bounded_chunks(spark):
    data = [("hot", i) for i in range(25)] + [("same", 3)] * 9 + [("cold", 1), ("cold", None)]
    df = pairs(spark, data).repartition(4)
    g = keyed.group_by_key(df, chunk_rows=4)
    got = g.collect()
    assert all(len(r["values"]) <= 4 and list(r["values"]) == sorted(r["values"], key=lambda x: (x is None, x)) or r["k"] == "cold" for r in got)
    assert len({(r["k"], r["chunk"]) for r in got}) == len(got)
    assert Counter((r["k"], x) for r in got for x in r["values"]) == Counter(data)
    cold = [r for r in got if r["k"] == "cold"]
    assert len(cold) == 1 and cold[0]["chunk"] == 0
    again = keyed.group_by_key(df.repartition(3), chunk_rows=4).collect()
    assert sorted((r["k"], r["chunk"], str(r["values"])) for r in got) == sorted((r["k"], r["chunk"], str(r["values"])) for r in again)
    c = joins.cogroup([df, pairs(spark, [("hot", 99)])], chunk_rows=4).collect()
    assert sum(len(r["values_1"]) for r in c if r["k"] == "hot") == 1
    assert sum(len(r["values_0"]) for r in c if r["k"] == "hot") == 25
    assert all(len(r["values_0"]) <= 4 and len(r["values_1"]) <= 4 for r in c)


# ---------------------------------------------------------------- sets

def test_sets(spark):
    a, b = NUMBERS[:30], NUMBERS[20:]
    da, db = ints(spark, a, 2), ints(spark, b, 3)
    assert Counter(r[0] for r in sets.union_all(da, db).collect()) == Counter(a + b)
    assert sorted(r[0] for r in sets.intersection(da, db).collect()) == sorted(set(a) & set(b))
    assert sorted(r[0] for r in sets.distinct(da).collect()) == sorted(set(a))
    n = spark.createDataFrame([(None,), (8,)], "x long")
    assert len(sets.intersection(n, n).collect()) == 2


def test_union_is_positional(spark):
    u = sets.union_all(ints(spark, [1], name="x"), ints(spark, [2], name="y"))
    assert u.columns == ["x"] and sorted(r[0] for r in u.collect()) == [1, 2]


# ---------------------------------------------------------------- aggregation

def test_reduce_fold_aggregate(spark):
    d, empty = ints(spark, NUMBERS, 3), spark.createDataFrame([], "x long")
    total = sum(NUMBERS)
    assert agg.reduce(d, "x", "sum").first()[0] == agg.fold(d, "x", 0, "sum").first()[0] == total
    assert agg.unpickle(agg.reduce_with(d, "x", operator.add)) == total
    assert agg.reduce(empty, "x", "sum").first()[0] == 0
    assert agg.reduce(empty, "x", "max").first()[0] is None
    assert agg.reduce_with(empty, "x", operator.add).count() == 0
    assert tuple(agg.aggregate_sum_count(d, "x").first()) == (total, len(NUMBERS))
    assert tuple(agg.aggregate_sum_count(empty, "x").first()) == (0, 0)
    spread = agg.aggregate_with(d, "x", (99, -99), lambda a, x: (min(a[0], x), max(a[1], x)),
                                lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), "lo long, hi long")
    assert tuple(spread.first()) == (min(NUMBERS), max(NUMBERS))


def test_folds_follow_one_rule(spark):
    d, p = ints(spark, [1, 2]), pairs(spark, [("a", 1), ("a", 2)])
    assert agg.fold(d, "x", 8, "bit_or").first()[0] == keyed.fold_by_key(p, 8, "bit_or").first()["v"] == 11
    assert agg.fold(d, "x", 7, "max").first()[0] == keyed.fold_by_key(p, 7, "max").first()["v"] == 7
    assert agg.fold(spark.createDataFrame([], "x long"), "x", 8, "bit_or").first()[0] == 8
    for bad in (("sum", 5), ("product", 0), ("bit_xor", 1), ("count", 0)):
        with pytest.raises(ValueError):
            agg.folded(F.sum("x"), bad[1], bad[0])


def test_tree_reduce(spark):
    d = ints(spark, NUMBERS, 10)
    for fan in (1, 2, 5, 300):
        assert agg.tree_reduce(d, "x", "sum", fan_in=fan).first()[0] == sum(NUMBERS)
        assert tuple(agg.tree_aggregate_sum_count(d, "x", fan_in=fan).first()) == (sum(NUMBERS), len(NUMBERS))


def test_tree_merges_of_python_functions(spark):
    d = ints(spark, NUMBERS, 10)
    for depth in (1, 2, 4):
        assert agg.unpickle(agg.reduce_with(d, "x", operator.add, depth=depth, fan_in=2)) == sum(NUMBERS)
        distinct = agg.aggregate_with(d, "x", set(), lambda a, x: a | {x}, operator.or_, depth=depth, fan_in=2)
        assert agg.unpickle(distinct) == set(NUMBERS)


def test_max_min_by_key(spark):
    d = ints(spark, NUMBERS, 3)
    assert agg.max_value(d, "x").first()[0] == max(NUMBERS) and agg.min_value(d, "x").first()[0] == min(NUMBERS)
    assert agg.arg_max(d, "x", F.col("x").cast("string")).first()[0] == max(NUMBERS, key=str)
    assert agg.arg_min(d, "x", F.col("x").cast("string")).first()[0] == min(NUMBERS, key=str)


def test_stats_population_and_sample(spark):
    import statistics as st

    s = agg.stats(ints(spark, NUMBERS, 3), "x").first()
    assert s["count"] == len(NUMBERS) and abs(s["mean"] - st.mean(NUMBERS)) < 1e-9
    assert abs(s["variance"] - st.pvariance(NUMBERS)) < 1e-6 and abs(s["stdev"] - st.pstdev(NUMBERS)) < 1e-9
    assert abs(s["sample_variance"] - st.variance(NUMBERS)) < 1e-6 and abs(s["sample_stdev"] - st.stdev(NUMBERS)) < 1e-9
    one = spark.createDataFrame([(4.5,)], "x double")
    assert agg.sample_stdev(one, "x").first()[0] is None
    assert agg.count_rows(spark.createDataFrame([(None,), (1,)], "x long")).first()[0] == 2


def test_count_by_value_keeps_null_group(spark):
    d = spark.createDataFrame([(v,) for v in [*NUMBERS, None, None]], "x long")
    assert {r[0]: r[1] for r in agg.count_by_value(d).collect()} == Counter([*NUMBERS, None, None])


def _counts(h):
    return [r["count"] for r in sorted(h.collect())]


def test_histograms(spark):
    d = spark.createDataFrame([(x / 4,) for x in range(0, 81)], "x double")
    h = sorted(histogram.histogram_even(d, "x", 4).collect())
    assert [(r["low"], r["high"], r["count"]) for r in h] == [(0.0, 5.0, 20), (5.0, 10.0, 20), (10.0, 15.0, 20), (15.0, 20.0, 21)]
    assert _counts(histogram.histogram_edges(d, "x", [1, 2.5, 20])) == [6, 71]
    words = spark.createDataFrame([(w,) for w in ("fig", "kiwi", "lime", "pear", "plum", "zest")], "x string")
    assert _counts(histogram.histogram_edges(words, "x", ["g", "l", "pear", "q"])) == [1, 1, 2]
    same = spark.createDataFrame([(7.5,), (7.5,), (None,), (float("nan"),)], "x double")
    only = histogram.histogram_even(same, "x", 4).collect()
    assert [(r["low"], r["high"], r["count"]) for r in only] == [(7.5, 7.5, 2)]
    for bad in ([0, 5, 5], [3, 1], [1], [0, None], [0, float("nan"), 2], [1, "b"]):
        with pytest.raises(histogram.HistogramError):
            histogram.histogram_edges(d, "x", bad)
    with pytest.raises(histogram.HistogramError):
        histogram.histogram_even(spark.createDataFrame([], "x double"), "x", 3)


def test_histogram_edges_keep_their_type(spark):
    import datetime as dt

    big = 2**53
    d = ints(spark, [big, big + 1, big + 2])
    h = histogram.histogram_edges(d, "x", [big, big + 1, big + 3, big + 10])
    assert _counts(h) == [1, 2, 0] and h.schema["low"].dataType.simpleString() == "bigint"
    days = spark.createDataFrame([(dt.date(2020, 1, k),) for k in (1, 2, 9)], "x date")
    h = histogram.histogram_edges(days, "x", [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 9)])
    assert _counts(h) == [1, 2] and h.schema["high"].dataType.simpleString() == "date"


def test_histogram_zero_buckets_reported(spark):
    d = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert [r["count"] for r in sorted(histogram.histogram_even(d, "x", 5).collect())] == [1, 0, 0, 0, 1]


# ---------------------------------------------------------------- keyed

def test_keyed(spark):
    data = [(f"k{x % 5}", x) for x in NUMBERS]
    p, per = pairs(spark, data).repartition(3), {}
    for k, v in data:
        per.setdefault(k, []).append(v)
    assert dict(map(tuple, keyed.reduce_by_key(p, "sum").collect())) == {k: sum(v) for k, v in per.items()}
    assert dict(map(tuple, keyed.count_by_key(p).collect())) == {k: len(v) for k, v in per.items()}
    assert dict(map(tuple, keyed.fold_by_key(p, 0, "sum").collect())) == {k: sum(v) for k, v in per.items()}
    c = keyed.combine_by_key(p, lambda v: [v], lambda a, v: [*a, v], lambda a, b: a + b, finish=sorted, out_type="array<long>")
    assert {r["k"]: list(r["v"]) for r in c.collect()} == {k: sorted(v) for k, v in per.items()}
    g = keyed.group_by_key(p, chunk_rows=100).collect()
    assert {r["k"]: list(r["values"]) for r in g} == {k: sorted(v) for k, v in per.items()}
    folded = keyed.fold_by_key_with(p, 1000, min, out_type="long")
    assert dict(map(tuple, folded.collect())) == {k: min(v) for k, v in per.items()}


def test_combine_by_composite_nan_and_zero_keys(spark):
    nan = float("nan")
    d = spark.createDataFrame([((1, nan), 1), ((1, nan), 2), ((1, 0.0), 4), ((1, -0.0), 8), ((None, None), 16), (None, 32)], "k struct<a:long,b:double>, v long")
    c = keyed.combine_by_key(d.repartition(4), int, operator.add, operator.add, out_type="long").collect()
    assert sorted(r["v"] for r in c) == [3, 12, 16, 32]
    f = spark.createDataFrame([(nan, 1), (nan, 2), (0.0, 4), (-0.0, 8)], "k double, v long").repartition(3)
    assert sorted(r["v"] for r in keyed.combine_by_key(f, int, operator.add, operator.add, out_type="long").collect()) == [3, 12]
    two = d.select(F.col("v").alias("w"), (F.col("v") % 3).alias("m"), F.lit("x").alias("n"))
    got = keyed.combine_by_key(two, int, operator.add, operator.add, k=["m", "n"], v="w", out_type="long")
    assert got.columns == ["m", "n", "v"] and R(got) == [(1, "x", 21), (2, "x", 42)]


def test_group_by_expr(spark):
    d = ints(spark, NUMBERS)
    g = {r["k"]: sorted(x["x"] for x in r["values"]) for r in keyed.group_by(d, "abs(x) % 3", chunk_rows=100).collect()}
    assert g == {m: sorted(x for x in NUMBERS if abs(x) % 3 == m) for m in (0, 1, 2)}


def test_last_value_by_key(spark):
    data = [(x % 4, x, i) for i, x in enumerate(NUMBERS)]
    df = spark.createDataFrame(data, "k long, v long, o long").repartition(3)
    assert dict(map(tuple, keyed.last_value_by_key(df, "o").collect())) == {k: v for k, v, _ in data}


# ---------------------------------------------------------------- order

def test_sort_by_key_text(spark):
    words = [f"{RND.choice('aAbBcC9')}{x}" for x in NUMBERS]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "k string, v long").repartition(3)
    for n in (None, 1, 4):
        assert [r[0] for r in order.sort_by_key(df, ["k"], num_partitions=n).collect()] == sorted(words)
        lower = [r[0].lower() for r in order.sort_by(df, F.lower("k"), num_partitions=n).collect()]
        assert lower == sorted(w.lower() for w in words)


def test_join_results_sort_in_few_partitions(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = order.sort_by_key(joins.join(li, o, "l_orderkey"), ["o_custkey", "l_quantity"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert layout.num_partitions(s) <= n


def test_sort_nulls_and_descending(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "k long")
    assert [r[0] for r in order.sort_by_key(df, "k").collect()] == [None, 1, 2]
    assert [r[0] for r in order.sort_by_key(df, "k", ascending=False).collect()] == [2, 1, None]


def test_hot_key_sort_spreads_over_partitions(spark):
    df = spark.createDataFrame([(7, i) for i in range(300)] + [(i, i) for i in range(30)], "k long, v long")
    s = order.sort_by_key(df.repartition(4), "k", num_partitions=6)
    per = s.groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in per) < 300  # the hot key does not land in one task
    ks = [r[0] for r in s.collect()]
    assert ks == sorted(ks)


def test_top_take(spark):
    d = ints(spark, NUMBERS, 3)
    assert [r[0] for r in order.top(d, 5, ["x"]).collect()] == sorted(NUMBERS, reverse=True)[:5]
    assert [r[0] for r in order.top(d, 5, [F.col("x").cast("string")]).collect()] == sorted(NUMBERS, key=str, reverse=True)[:5]
    assert [r[0] for r in order.take_ordered(d, 6, ["x"]).collect()] == sorted(NUMBERS)[:6]
    assert [r[0] for r in order.take_ordered(d, 6, [-F.col("x")]).collect()] == sorted(NUMBERS, reverse=True)[:6]
    assert [r[0] for r in order.take(ints(spark, NUMBERS), 4).collect()] == NUMBERS[:4]
    assert order.is_empty(spark.createDataFrame([], "x long")).first()[0] is True
    assert order.is_empty(d).first()[0] is False


def test_casts(spark):
    df = spark.createDataFrame([(0.1, 2.9), (-2.9, 0.1)], "k double, v double")
    f = order.sort_float32_by_key(df).collect()
    assert f[1]["k"] == 0.10000000149011612 and f[0]["v"] == 0.10000000149011612
    i = order.sort_int32_by_key(df).collect()
    assert [tuple(r) for r in i] == [(-2, 0), (0, 2)]
    d = order.sort_range_partitioned(df, 2, ascending=False).collect()
    assert [r["k"] for r in d] == sorted([r["k"] for r in d], reverse=True)


# ---------------------------------------------------------------- position

def test_zip_with_index_and_unique_id(spark):
    df = ints(spark, NUMBERS).repartitionByRange(3, "x")
    z = [tuple(r) for r in position.zip_with_index(df).orderBy("idx").collect()]
    assert [i for i, _ in z] == list(range(len(NUMBERS))) and sorted(x for _, x in z) == sorted(NUMBERS)
    u = position.zip_with_unique_id(ints(spark, NUMBERS).repartition(3))
    assert len({r[0] for r in u.collect()}) == len(NUMBERS)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_unique_ids_need_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("unique-ids", "")
    u = position.zip_with_unique_id(spark.range(100, numPartitions=4).select(F.col("id").alias("x")), stride=10)
    assert not tracker.getJobIdsForGroup("unique-ids")
    spark.sparkContext.setJobGroup("", "")
    assert "Exchange" not in u._jdf.queryExecution().executedPlan().toString()
    assert sorted(R(u))[:3] == [(0, 0), (1, 25), (2, 50)] and len({r["uid"] for r in u.collect()}) == 100
    with pytest.raises(Exception, match="more than 3 partitions"):
        position.zip_with_unique_id(spark.range(100, numPartitions=4), stride=3).collect()


def test_cleanup_removes_the_folders_of_results(spark):
    import os

    from tessera import session
    z = position.row_index(spark.range(50), ["id"])
    assert z.count() == 50
    made = [p.removeprefix("file:") for p in session._MADE]
    held = session.shared_dir(spark, "held")
    spark.range(3).write.parquet(held)
    assert session.cleanup(spark, keep=[held]) >= 1 and not any(os.path.isdir(p) for p in made)
    assert spark.read.parquet(held).count() == 3 and session.cleanup(spark) == 1


def test_row_index_equals_row_number_for_any_partitioning(spark):
    df = spark.createDataFrame([(i % 17, i) for i in range(500)], "k long, v long")
    want = [(i, k, v) for i, (k, v) in enumerate(sorted((i % 17, i) for i in range(500)))]
    for n in (1, 3, 8):
        got = sorted(tuple(r) for r in position.row_index(df.repartition(n), ["k", "v"]).collect())
        assert got == want


def test_zip_frames(spark):
    a = ints(spark, list(range(40)), 2)
    b = ints(spark, list(range(700, 740)), 3, name="y")
    z = position.zip_frames(a, b, ["x"], ["y"])
    assert sorted((r["x"], r["y"]) for r in z.collect()) == [(i, 700 + i) for i in range(40)]
    with pytest.raises(ValueError):
        position.zip_frames(a, ints(spark, [1]), ["x"], ["x"])


# ---------------------------------------------------------------- sampling (S22, S23, K)

def test_take_sample_sizes(spark):
    d = ints(spark, list(range(30)))
    assert sampling.take_sample_with_replacement(d, 70, seed=1).count() == 70
    assert sampling.take_sample(d, 7, ["x"], seed=1).count() == 7
    assert sampling.take_sample(d, 45, ["x"], seed=1).count() == 30
    with pytest.raises(ValueError):
        sampling.take_sample(d, -1, ["x"])
    with pytest.raises(ValueError):
        sampling.sample(d, -0.1)


def test_hash_split_disjoint_complete(spark):
    d = ints(spark, list(range(1000)), 4)
    s = sampling.split_hash(d, [2, 3], ["x"], seed=17)
    parts = {r[0]: r[1] for r in s.groupBy("split").count().collect()}
    assert sum(parts.values()) == 1000 and set(parts) == {0, 1}
    again = sampling.split_hash(d.repartition(7), [2, 3], ["x"], seed=17)
    assert R(s) == R(again)


def test_sample_by_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", i) for i in range(1000)], "k string, v long")
    s = sampling.sample_by_key_hash(df, "k", {"a": 0.2, "b": 0.1}, ["k", "v"], seed=3)
    c = {r[0]: r[1] for r in s.groupBy("k").count().collect()}
    assert 100 < c["a"] < 300 and 50 < c["b"] < 150
    with pytest.raises(KeyError):
        sampling.sample_by_key_hash(df, "k", {"a": 0.2}, ["v"], strict=True)


def test_approx(spark):
    d = ints(spark, list(range(1000)), 10)
    a = sampling.approx_stats(d, "x", ["x"], fraction=0.3, confidence=0.95).first()
    assert a["count_low"] <= 1000 <= a["count_high"]
    assert abs(a["mean_mean"] - 499.5) / 499.5 < 0.1
    txt = spark.createDataFrame([(str(i),) for i in range(1000)], "s string")
    e = sampling.approx_count_distinct(txt, "s", 0.05).first()[0]
    assert 950 <= e <= 1050
    m = spark.createDataFrame([(i % 20,) for i in range(1000)], "x long")
    assert 18 <= sampling.approx_count_distinct(m, "x", 0.05).first()[0] <= 22
    assert 19 <= sampling.approx_count_distinct(m, "x", 0.005).first()[0] <= 21
    with pytest.raises(ValueError):
        sampling.approx_count_distinct(m, "x", 0)


def test_combine_by_key_bounded_map_side(spark):
    df = spark.createDataFrame([(i % 50, 1) for i in range(1000)], "k long, v long").repartition(3)
    c = keyed.combine_by_key(df, lambda v: v, lambda a, v: a + v, lambda a, b: a + b, out_type="long",
                             fan_in=1)
    assert sorted(tuple(r) for r in c.collect()) == [(i, 20) for i in range(50)]


def test_strict_empty(spark):
    from tessera.operators import agg as A
    empty = spark.createDataFrame([], "x long")
    with pytest.raises(ValueError):
        A.reduce(empty, "x", "sum", strict=True)
    with pytest.raises(ValueError):
        A.max_value(empty, "x", strict=True)
    with pytest.raises(ValueError):
        order.first(empty, strict=True)
    assert order.first(ints(spark, [2, 3, 4]), ["x"], strict=True).first()[0] == 2


def test_poisson_sampling(spark):
    d = ints(spark, list(range(2000)), 4)
    s = sampling.sample_hash(d, 1.5, ["x"], seed=2, with_replacement=True)
    n = s.count()
    assert abs(n - 3000) < 6 * (3000 ** 0.5)
    per = [r[1] for r in s.groupBy("x").count().collect()]
    assert max(per) >= 3
    again = sampling.sample_hash(d.repartition(3), 1.5, ["x"], seed=2, with_replacement=True)
    assert R(s) == R(again)
    assert sampling.poisson_thresholds(0.0) == [1.0]


def test_python_map_paths(spark):
    d = spark.createDataFrame([("ab",), ("c",)], "s string")
    assert sorted(r[0] for r in rows.map_with(d, lambda s: s.str.len(), "long", "s").collect()) == [1, 2]
    fm = rows.flat_map_with(d, lambda r: [(c,) for c in r["s"]], "ch string")
    assert sorted(r[0] for r in fm.collect()) == ["a", "b", "c"]


def test_copartitioned_join_needs_no_extra_shuffle(spark):
    a = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = spark.range(0, 1000, 3).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    pa_, pb = layout.partition_by(a, 8, "k"), layout.partition_by(b, 8, "k")
    j = joins.join(pa_, pb, "k", null_safe=False)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert j.count() == 334
    assert joins.join(pa_, pb, "k").count() == 334  # non-nullable keys: plain equality chosen


def test_zip_with_index_after_a_shuffle(spark):
    d = spark.range(5000).repartitionByRange(7, "id").select(F.col("id").alias("x"))
    z = position.zip_with_index(d)
    got = sorted(r["idx"] for r in z.select("idx").collect())
    assert got == list(range(5000))


def test_key_by_then_cogroup(spark):
    x = rows.key_by(ints(spark, [-3, 0, 4]), F.abs("x")).select("k", F.col("x").alias("v"))
    y = spark.createDataFrame([(i, 10 * i) for i in range(6)], "k long, v long")
    got = {r["k"]: (list(r["values_0"]), list(r["values_1"])) for r in joins.cogroup([x, y], chunk_rows=10).collect()}
    assert got == {0: ([0], [0]), 1: ([], [10]), 2: ([], [20]), 3: ([-3], [30]), 4: ([4], [40]), 5: ([], [50])}


def test_count_approx_reads_everything_at_fraction_one(spark):
    d = ints(spark, list(range(1000)), 10)
    a = sampling.approx_stats(d, "x", ["x"], fraction=1.0, confidence=0.95).first()
    assert a["count_mean"] == a["count_low"] == a["count_high"] == 1000
    assert abs(a["sum_mean"] - 499500) < 1e-6


def test_poisson_copies_of_large_means(spark):
    d = ints(spark, list(range(400)), 4)
    s = sampling.sample_hash(d, 250.0, ["x"], seed=4, with_replacement=True).groupBy("x").count().collect()
    mean = sum(r[1] for r in s) / 400
    spread = sum((r[1] - mean) ** 2 for r in s) / 399
    assert abs(mean - 250) < 4 and 190 < spread < 320  # a Poisson variable's variance is its mean


def test_uniform_numbers_have_52_bits(spark):
    from tessera.functions.exprs import unit_hash

    u = [r[0] for r in spark.range(1000).select(unit_hash("id", seed=1)).collect()]
    assert all(0 <= x < 1 and (x * 2**52).is_integer() for x in u) and any(not (x * 2**40).is_integer() for x in u)


def test_histogram_many_uneven_edges_matches_bisect(spark):
    import bisect
    import random

    rnd = random.Random(3)
    edges = sorted({round(rnd.uniform(0, 1000), 3) for _ in range(300)})
    vals = [rnd.uniform(-10, 1010) for _ in range(3000)] + edges
    d = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in sorted(histogram.histogram_edges(d, "x", edges).collect())]
    want = [0] * (len(edges) - 1)
    for v in vals:
        if edges[0] <= v <= edges[-1]:
            want[min(bisect.bisect_right(edges, v) - 1, len(edges) - 2)] += 1
    assert got == want
