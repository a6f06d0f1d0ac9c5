"""Registered queries: sources and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.oracle_sql import DOC_LINES, unit_hash_sql
from tessera.plans.registry import register
from tessera.session import shared_dir
from tessera.sources import generators, sinks, text
from tessera.sources.tables import load


@register("src_text_lines", oracle=f"SELECT doc_id, line AS value FROM ({DOC_LINES})")
def src_text_lines(spark, sf_dir):
    return text.lines_from(load(spark, sf_dir, "documents"), keep=("doc_id",))


@register("src_vectors", oracle="""
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS x
FROM embeddings
""")
def src_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    as_text = text.format_vectors(e.select("vec_id", F.col("embedding").cast("array<double>").alias("p")),
                                  keep=("vec_id",))
    v = text.vectors_of(as_text, keep=("vec_id",))
    return v.select("vec_id", F.posexplode("p").alias("d", "x"))


@register("src_pairs", oracle="SELECT l_extendedprice AS k, l_quantity AS v FROM lineitem")
def src_pairs(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    lines = text.format_pairs(li, "l_extendedprice", "l_quantity")
    return text.pairs_of(lines)


def _written(spark, frame, column="value"):
    path = shared_dir(spark, "lines")
    sinks.write_text(frame, path, column=column)
    return path


@register("src_read_lines", oracle="SELECT url AS value FROM pages")
def src_read_lines(spark, sf_dir):
    return text.read_lines(spark, _written(spark, load(spark, sf_dir, "pages"), "url"))


@register("src_read_vectors", oracle="SELECT CAST(embedding AS DOUBLE[]) AS p FROM embeddings")
def src_read_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("p"))
    return text.read_vectors(spark, _written(spark, text.format_vectors(e)))


@register("src_read_pairs", oracle="SELECT l_extendedprice AS k, l_quantity AS v FROM lineitem")
def src_read_pairs(spark, sf_dir):
    lines = text.format_pairs(load(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    return text.read_pairs(spark, _written(spark, lines))


def _u(parts, seed, low, high):
    return f"({unit_hash_sql(*parts, seed=seed)} * {float(high - low)!r} + {float(low)!r})"


@register("gen_points", oracle=f"""
SELECT o_orderkey,
       {_u(['o_orderkey', "'0'"], 5, 0.1, 10.0)} AS x0,
       {_u(['o_orderkey', "'1'"], 5, 0.1, 10.0)} AS x1,
       {_u(['o_orderkey', "'2'"], 5, 0.1, 10.0)} AS x2
FROM orders
""")
def gen_points(spark, sf_dir):
    p = generators.gen_points(load(spark, sf_dir, "orders"), "o_orderkey", dims=3, seed=5)
    return p.select("o_orderkey", *[F.col("p")[i].alias(f"x{i}") for i in range(3)])


@register("gen_int_points", oracle=f"""
SELECT c_custkey,
       {', '.join(f"CAST(trunc({_u(['c_custkey', repr(str(d))], 9, 0.1, 10.0)}) AS INTEGER) AS x{d}" for d in range(4))}
FROM customer
""")
def gen_int_points(spark, sf_dir):
    p = generators.gen_int_points(load(spark, sf_dir, "customer"), "c_custkey", dims=4, seed=9)
    return p.select("c_custkey", *[F.col("p")[i].alias(f"x{i}") for i in range(4)])


@register("gen_pairs", oracle=f"""
WITH s AS (SELECT c_custkey, unnest(generate_series(1, 10)) AS size_step FROM customer),
r AS (SELECT c_custkey, size_step, unnest(generate_series(1, size_step)) AS rep FROM s)
SELECT c_custkey, CAST(size_step AS INTEGER) AS size_step, CAST(rep AS INTEGER) AS rep,
       {_u(['c_custkey', 'size_step', 'rep', "'k'"], 2, 0.0, 10.0)} AS k,
       {_u(['c_custkey', 'size_step', 'rep', "'v'"], 2, 0.0, 10.0)} AS v
FROM r
""")
def gen_pairs(spark, sf_dir):
    return generators.gen_pairs(load(spark, sf_dir, "customer"), "c_custkey", seed=2, ladder=10)


@register("gen_replicated_text", oracle="""
SELECT CAST(unnest(generate_series(1, 3)) AS INTEGER) AS copy, doc_id, text FROM documents
""")
def gen_replicated_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return generators.replicate(d, 3)
