"""Registered queries: the three applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import kmeans, sorting, wordcount
from tessera.plans.oracle_sql import DOC_LINES, unit_hash_sql
from tessera.plans.registry import register
from tessera.sources.tables import load


@register("wc_split_tokens", oracle=f"""
WITH lines AS ({DOC_LINES})
SELECT CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS split_tokens FROM lines
""")
def wc_split_tokens(spark, sf_dir):
    return wordcount.word_count_tokens(load(spark, sf_dir, "documents"))


@register("wc_space_runs", oracle=f"""
WITH lines AS ({DOC_LINES})
SELECT CAST(sum(len(regexp_extract_all(line, '[^ ]+'))) AS BIGINT) AS space_runs FROM lines
""")
def wc_space_runs(spark, sf_dir):
    return wordcount.word_count_runs(load(spark, sf_dir, "documents"))


@register("wc_frequencies", oracle=f"""
WITH lines AS ({DOC_LINES})
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(string_split(line, ' ')) AS word FROM lines)
GROUP BY word
""")
def wc_frequencies(spark, sf_dir):
    return wordcount.word_frequencies(load(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- sorting

@register("sort_pairs_app", oracle="""
SELECT row_number() OVER (ORDER BY l_extendedprice, l_quantity) - 1 AS idx,
       l_extendedprice AS k, l_quantity AS v
FROM lineitem
""")
def sort_pairs_app(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return sorting.sort_pairs(sorting.pair_lines(li, "l_extendedprice", "l_quantity"))


# ---------------------------------------------------------------- k-means

K = 10


def _points(spark, sf_dir):
    return kmeans.as_points(load(spark, sf_dir, "embeddings"), "embedding", "vec_id")


def _first_centers(points):
    # fixed start: the k points with the smallest ids (k x d numbers)
    return [list(r["p"]) for r in points.orderBy("vec_id").limit(K).select("p").collect()]


_P = "p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"
_DIST = ("list_reduce(list_transform(range(1, len(p.p) + 1), "
         "lambda j: (p.p[j] - c.c[j]) * (p.p[j] - c.c[j])), lambda a, b: a + b)")


def _assign_sql(cent: str, name: str) -> str:
    return (f"{name} AS (SELECT vec_id, i AS cluster FROM ("
            f"SELECT p.vec_id, c.i, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_DIST}, c.i) AS rn "
            f"FROM p CROSS JOIN {cent} c) WHERE rn = 1)")


def _update_sql(cent: str, asg: str, name: str) -> str:
    return (f"{name}_x AS (SELECT a.cluster AS i, unnest(range(1, len(p.p) + 1)) AS j, unnest(p.p) AS x "
            f"FROM {asg} a JOIN p USING (vec_id)), "
            f"{name}_m AS (SELECT i, j, sum(x) / count(*) AS m FROM {name}_x GROUP BY i, j), "
            f"{name} AS (SELECT i, list(m ORDER BY j) AS c FROM {name}_m GROUP BY i "
            f"UNION ALL SELECT i, c FROM {cent} WHERE i NOT IN (SELECT cluster FROM {asg}))")


_C0_FIRST = f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, p AS c FROM p ORDER BY vec_id LIMIT {K})"
_C0_HASH = (f"c0 AS (SELECT row_number() OVER (ORDER BY {unit_hash_sql('vec_id', seed=1)}, vec_id) - 1 AS i, "
            f"p AS c FROM p ORDER BY {unit_hash_sql('vec_id', seed=1)}, vec_id LIMIT {K})")


@register("kmeans_assign", oracle=f"""
WITH {_P}, {_C0_FIRST}, {_assign_sql('c0', 'a0')}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM a0
""")
def kmeans_assign(spark, sf_dir):
    pts = _points(spark, sf_dir)
    return kmeans.assign_sql(pts, _first_centers(pts)).select("vec_id", "cluster")


@register("kmeans_assign_arrow", oracle=f"""
WITH {_P}, {_C0_FIRST}, {_assign_sql('c0', 'a0')}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM a0
""")
def kmeans_assign_arrow(spark, sf_dir):
    pts = _points(spark, sf_dir)
    return kmeans.assign_arrow(pts, _first_centers(pts)).select("vec_id", "cluster")


@register("kmeans_step", oracle=f"""
WITH {_P}, {_C0_FIRST}, {_assign_sql('c0', 'a0')}, {_update_sql('c0', 'a0', 'c1')}
SELECT CAST(i AS INTEGER) AS cluster, CAST(unnest(range(0, len(c))) AS INTEGER) AS dim,
       round(unnest(c), 6) AS value
FROM c1
""")
def kmeans_step(spark, sf_dir):
    pts = _points(spark, sf_dir)
    return kmeans.step_frame(pts, _first_centers(pts)).select(
        "cluster", "dim", F.round("value", 6).alias("value"))


def _rounds_sql(rounds: int) -> str:
    """So many rounds from c0; once converged, further ones change nothing."""
    steps = []
    for i in range(rounds):
        steps += [_assign_sql(f"c{i}", f"a{i}"), _update_sql(f"c{i}", f"a{i}", f"c{i + 1}")]
    steps.append(_assign_sql(f"c{rounds}", f"a{rounds}"))
    return ",\n".join(steps).replace(" AS (", " AS MATERIALIZED (")


FIT_ROUNDS = 40  # of the oracle; the query runs until the centres stand still


@register("kmeans_fit", oracle=f"""
WITH {_P}, {_C0_HASH},
{_rounds_sql(FIT_ROUNDS)},
sizes AS (SELECT cluster, count(*) AS size FROM a{FIT_ROUNDS} GROUP BY cluster)
SELECT CAST(i AS INTEGER) AS cluster, coalesce(size, 0) AS size, CAST(unnest(range(0, len(c))) AS INTEGER) AS dim,
       round(unnest(c), 6) AS value
FROM c{FIT_ROUNDS} LEFT JOIN sizes ON i = cluster
""")
def kmeans_fit(spark, sf_dir):
    pts = _points(spark, sf_dir)
    res = kmeans.kmeans(pts, K, converge_dist=1e-12, key="vec_id", seed=1)
    sizes = kmeans.assign_arrow(pts, res.centers).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    centers = spark.createDataFrame([(i, c) for i, c in enumerate(res.centers)], "cluster int, c array<double>")
    found = centers.join(sizes, "cluster", "left")
    return found.select("cluster", F.coalesce("size", F.lit(0)).alias("size"), F.posexplode("c").alias("dim", "value")).withColumn("value", F.round("value", 6))
