"""k-means, sorting app, text sources, generators and sinks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import kmeans, sorting
from tessera.session import shared_dir
from tessera.sources import generators, sinks, text
from tessera.sources.tables import load

SF = "/root/testdata/sf0.001"


def pts(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(data)], "vec_id long, p array<double>")


def test_ties_and_nan(spark):
    centers = [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    df = pts(spark, [(0.9, 0.9), (0.1, 0.0), (float("nan"), 0.0)])
    got = [r["cluster"] for r in kmeans.assign_sql(df, centers).orderBy("vec_id").collect()]
    assert got == [1, 0, 0]
    got2 = [r["cluster"] for r in kmeans.assign_arrow(df, centers).orderBy("vec_id").collect()]
    assert got2 == [1, 0, 0]


def test_empty_cluster_keeps_center(spark):
    df = pts(spark, [(0.0, 0.1), (0.1, 0.0)])
    new, move, sizes = kmeans.kmeans_step(df, [[0.0, 0.0], [100.0, 100.0]])
    assert new[1] == [100.0, 100.0] and sizes == [2, 0]
    assert new[0] == pytest.approx([0.05, 0.05])


def test_expression_and_arrow_assignments_agree(spark):
    p = kmeans.as_points(load(spark, SF, "embeddings"), "embedding", "vec_id")
    res = kmeans.kmeans(p, 5, 1e-12, key="vec_id")
    assert res.converged and sum(res.sizes) == p.count()
    a = {r["vec_id"]: r["cluster"] for r in kmeans.assign_sql(p, res.centers).collect()}
    b = {r["vec_id"]: r["cluster"] for r in kmeans.assign_arrow(p, res.centers).collect()}
    assert a == b


def test_null_vectors_belong_to_no_cluster(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [9.0, 9.0])], "vec_id long, p array<double>")
    centers = [[0.0, 0.0], [9.0, 9.0]]
    for assigned in (kmeans.assign_sql(df, centers), kmeans.assign_arrow(df, centers)):
        assert {r["vec_id"]: r["cluster"] for r in assigned.collect()} == {1: 0, 2: None, 3: 1}
    assert kmeans.kmeans_step(df, centers)[2] == [1, 1]


def test_kmeans_step_is_bounded_in_memory(monkeypatch):
    rng = np.random.default_rng(1)
    points, centers = rng.normal(size=(3000, 768)), rng.normal(size=(1000, 768))
    import tracemalloc

    tracemalloc.start()
    nearest = kmeans._nearest(points, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all distances of one batch at once would be 18 GB
    some = rng.integers(0, 3000, 20)
    assert all(nearest[i] == ((centers - points[i]) ** 2).sum(axis=1).argmin() for i in some)


def test_kmeans_converges_and_matches_numpy(spark):
    rng = np.random.default_rng(0)
    data = np.vstack([rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3))])
    df = pts(spark, data.tolist())
    init = [data[0].tolist(), data[30].tolist()]
    res = kmeans.kmeans(df, 2, 1e-12, init=init)
    assert res.converged and sorted(res.sizes) == [30, 30]
    c = np.asarray(init)
    for _ in range(res.rounds):
        lab = np.argmin(((data[:, None, :] - c[None]) ** 2).sum(2), 1)
        c = np.vstack([data[lab == i].mean(0) for i in range(2)])
    assert np.allclose(np.asarray(res.centers), c)


def _all_rounds(df, centers, converge_dist=1e-12):
    """Every round over all points: what kmeans must give."""
    dist, moves, sizes = float("inf"), [], []
    while dist > converge_dist:
        centers, dist, sizes = kmeans.kmeans_step(df, centers)
        moves.append(dist)
    return centers, moves, sizes


def test_rounds_of_kmeans_are_not_a_job_each(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(4000, 6))
    df = pts(spark, data.tolist()).repartition(3).persist()
    sc, c = spark.sparkContext, data[:8]
    for _ in range(1000):
        own = ((data[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        old, c = c, np.array([data[own == j].mean(0) for j in range(8)])
        if ((c - old) ** 2).sum() <= 1e-12:
            break
    levels, inner = [], kmeans._Level.inner
    monkeypatch.setattr(kmeans._Level, "inner", lambda self, *a: levels.append(inner(self, *a)) or levels[-1])
    for near, share in ((100, 2), (1600, 16), (10**6, 16)):  # points that the driver may hold
        monkeypatch.setattr(kmeans, "NEAR_BYTES", near * 6 * 8)
        monkeypatch.setattr(kmeans, "LEVEL_SHARE", share)
        sc.setJobGroup(f"kmeans-{near}", "")
        res = kmeans.kmeans(df, 8, 1e-12, key="vec_id", init=data[:8].tolist())
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert res.converged and res.sizes == np.bincount(own, minlength=8).tolist()
        assert np.allclose(res.centers, c, atol=1e-9) and res.rounds == len(res.moves) > 40
        if near > 100:
            assert len(sc.statusTracker().getJobIdsForGroup(f"kmeans-{near}")) < res.rounds and res.passes < res.rounds / 2
    assert levels  # frames of the points near a border were used, too
    df.unpersist()


@pytest.mark.parametrize("near", [0, 5, 10**6])
@pytest.mark.parametrize("odd", ["ties", "null", "nan", "inf", "far", "tiny"])
def test_kmeans_gives_what_all_rounds_give(spark, monkeypatch, odd, near):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 4, (80, 2)).astype(float)  # many equal points, many as near to two centres
    if odd != "ties":
        data += rng.normal(size=data.shape) / 8
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(data * {"far": 1e160, "tiny": 1e-30}.get(odd, 1))]
    start = [rows[i][1] for i in (0, 1, 2, 3, 3)]  # two centres are the same
    extra = {"null": None, "nan": [float("nan"), 1.0], "inf": [float("inf"), 1.0]}
    rows += [(len(rows), extra[odd])] if odd in extra else []
    df = spark.createDataFrame(rows, "vec_id long, p array<double>").repartition(2).persist()
    monkeypatch.setattr(kmeans, "NEAR_BYTES", near * 2 * 8)
    limit = 1e-70 if odd == "tiny" else 1e-12
    res = kmeans.kmeans(df, 5, limit, key="vec_id", init=start)
    centers, moves, sizes = _all_rounds(df, start, limit)
    assert (res.rounds, res.sizes) == (len(moves), sizes)
    assert np.allclose(res.centers, centers, rtol=1e-9, atol=0, equal_nan=True)
    assert np.allclose(res.moves, moves, rtol=1e-6, atol=limit, equal_nan=True)
    assert res.converged == (moves[-1] <= limit)
    df.unpersist()


def test_kmeans_stops_after_max_iter(spark):
    rng = np.random.default_rng(5)
    df = pts(spark, rng.normal(size=(300, 3)).tolist())
    for most in (0, 1, 3):
        res = kmeans.kmeans(df, 4, 1e-12, key="vec_id", max_iter=most)
        assert (res.rounds, len(res.moves), res.converged) == (most, most, False)
    one = kmeans.kmeans(df, 1, 1e-12, key="vec_id")
    assert one.converged and one.sizes == [300]


def test_margins_hold(monkeypatch):
    rng = np.random.default_rng(6)
    points, c = rng.normal(size=(3000, 7)), rng.normal(size=(9, 7))
    ahead, speed = c + rng.normal(size=c.shape) / 20, rng.uniform(0.05, 1, 9)
    near, margin = kmeans._margins(points, c, ahead, speed)
    assert (near == kmeans._nearest(points, c)).all() and (margin > 0).sum() > 1500
    for t in (0, 0.3, 0.7, 1):
        for reach in (0.0, 0.01, 0.1):
            for _ in range(5):
                push = rng.normal(size=c.shape)
                push *= (reach * speed / np.sqrt((push**2).sum(axis=1)))[:, None]
                there = c + t * (ahead - c) + push
                sure = margin > reach * 1.000001
                assert (kmeans._nearest(points[sure], there) == near[sure]).all()


def test_sort_pairs_app(spark):
    lines = spark.createDataFrame([("(3.5, 1.0)",), ("(0.1, 4.5e-05)",), ("(2, 2)",)], "value string")
    got = [tuple(r) for r in sorting.sort_pairs(lines).orderBy("idx").collect()]
    assert got == [(0, 0.1, 4.5e-05), (1, 2.0, 2.0), (2, 3.5, 1.0)]
    bad = spark.createDataFrame([("(x, 1)",)], "value string")
    with pytest.raises(Exception):
        sorting.sort_pairs(bad).collect()


def test_vectors(spark):
    df = spark.createDataFrame([("1 2.5 3",)], "value string")
    assert text.vectors_of(df).first()["p"] == [1.0, 2.5, 3.0]
    with pytest.raises(Exception):
        text.vectors_of(spark.createDataFrame([("1  2",)], "value string")).collect()


def test_generators_reproducible_and_bounded(spark):
    keys = spark.range(200).withColumnRenamed("id", "k")
    g1 = generators.gen_points(keys, "k", dims=3, seed=4)
    g2 = generators.gen_points(keys.repartition(5), "k", dims=3, seed=4)
    assert sorted(map(tuple, g1.collect())) == sorted(map(tuple, g2.collect()))
    vals = [x for r in g1.collect() for x in r["p"]]
    assert min(vals) >= 0.1 and max(vals) < 10.0
    ints = [x for r in generators.gen_int_points(keys, "k").collect() for x in r["p"]]
    assert set(ints) <= set(range(10))
    lad = generators.gen_pairs(keys.limit(3), "k", ladder=10)
    assert lad.count() == 3 * 55
    assert generators.replicate(keys, 3).count() == 600


def test_text_sinks_roundtrip(spark):
    df = spark.createDataFrame([(v,) for v in ["", "foo", "", "bar", ""]], "value string")
    p = shared_dir(spark, "t")
    sinks.write_text(df, p)
    assert sorted(r[0] for r in spark.read.text(p).collect()) == ["", "", "", "bar", "foo"]
    p2 = shared_dir(spark, "tgz")
    sinks.write_text(spark.createDataFrame([("foo",), ("bar",)], "value string"), p2, codec="gzip")
    assert any(f.endswith(".gz") for f in os.listdir(p2.replace("file:", "")))
    assert sorted(r[0] for r in spark.read.text(p2).collect()) == ["bar", "foo"]


def test_sequence_and_objects(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    p = shared_dir(spark, "seq")
    sinks.write_sequence(df, p)
    assert sorted(tuple(r) for r in sinks.read_sequence(spark, p, "k long, v string").collect()) == [(1, "a"), (2, "b")]
    for fmt in ("parquet", "orc", "json"):
        q = shared_dir(spark, fmt)
        sinks.write_objects(df, q, fmt)
        back = spark.read.format(fmt).load(q).select(F.col("k").cast("long"), "v")
        assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_foreach_accumulates(spark):
    acc = spark.sparkContext.accumulator(0)
    sinks.for_each(spark.range(100), lambda r: acc.add(1))
    assert acc.value == 100


def test_malformed_pairs_fail(spark):
    good = spark.createDataFrame([("(1, -2.5)",), (" ( 3e2 ,4. ) ",)], "value string")
    assert sorted(tuple(r) for r in text.pairs_of(good).collect()) == [(1.0, -2.5), (300.0, 4.0)]
    for bad in ("(1 2, 3)", "((1,2", "1, 2", "(1, 2) x", "(1,2,3)", "(a, 1)", "", None):
        with pytest.raises(Exception, match="bad pair"):
            text.pairs_of(spark.createDataFrame([(bad,)], "value string")).collect()


def test_empty_sequence_file_reads_back(spark):
    path = shared_dir(spark, "seq")
    sinks.write_sequence(spark.createDataFrame([], "k long, v string"), path)
    assert sinks.read_sequence(spark, path, "k long, v string").count() == 0


def test_any_hadoop_output_format(spark):
    path = shared_dir(spark, "hadoop")
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    sinks.write_hadoop(df, path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat")
    assert sorted(tuple(r) for r in sinks.read_sequence(spark, path).collect()) == [("a", "1"), ("b", "2")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
