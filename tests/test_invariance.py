"""Same answer for 1, 3 and 8 input partitions."""

import operator

from pyspark.sql import functions as F

from tessera.operators import agg, histogram, joins, keyed, order, position, sampling, sets
from tessera.plans import kmeans

SF = "/root/testdata/sf0.001"


def _norm(rows):
    out = []
    for r in rows:
        t = []
        for x in r:
            t.append(tuple(sorted(x, key=str)) if isinstance(x, list) else x)
        out.append(tuple(t))
    return sorted(out, key=str)


def test_operators_do_not_depend_on_partitioning(spark):
    base = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_totalprice")
    results = []
    for n in (1, 3, 8):
        d = base.repartition(n)
        kv = d.select("k", "v")
        r = {
            "hist": _norm(histogram.histogram_even(d, "o_totalprice", 7).collect()),
            "cogroup": _norm(joins.cogroup([kv, kv.select("k", (F.col("v") * 2).alias("v"))], chunk_rows=3).collect()),
            "group": _norm(keyed.group_by_key(kv, chunk_rows=3).collect()),
            "combine": _norm(keyed.combine_by_key(kv, lambda v: v, lambda a, v: a + v, lambda a, b: a + b,
                                                  out_type="long").collect()),
            "top": [tuple(x) for x in order.top(kv, 5, ["v"]).collect()],
            "rank": _norm(order.ranked(kv, ["k", "v"]).collect()),
            "sample": _norm(sampling.sample_hash(kv, 0.3, ["v"], seed=4).collect()),
            "subtract": _norm(sets.subtract(kv.select("k"), kv.where("v % 2 = 0").select("k")).collect()),
            "reduce_with": agg.unpickle(agg.reduce_with(kv, "v", operator.add)),
            "tree": agg.tree_reduce(kv, "v", "sum").first()[0],
        }
        results.append(r)
    assert results[0] == results[1] == results[2]


def test_kmeans_does_not_depend_on_partitioning(spark):
    pts = kmeans.as_points(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", "vec_id")
    sizes = []
    for n in (1, 3, 8):
        res = kmeans.kmeans(pts.repartition(n), 4, 0.0, key="vec_id", max_iter=2)
        sizes.append(res.sizes)
    assert sizes[0] == sizes[1] == sizes[2]
