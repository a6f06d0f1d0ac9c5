"""Registered queries: element-wise operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessera.functions.exprs import tokens_of
from tessera.operators import layout, rows
from tessera.plans.oracle_sql import DOC_LINES
from tessera.plans.registry import register
from tessera.sources.tables import load


def _orders_pairs(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return rows.project_keys(o, "o_custkey", "o_totalprice")


@register("row_map", oracle="""
SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS plen, o_custkey * 2 AS k2 FROM orders
""")
def row_map(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return rows.map_rows(o, F.col("o_orderkey"), F.length("o_orderpriority").cast("long").alias("plen"),
                         (F.col("o_custkey") * 2).alias("k2"))


@register("row_flat_map", oracle=f"""
WITH lines AS ({DOC_LINES})
SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM lines
""")
def row_flat_map(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return rows.flat_map(d, tokens_of("text"), alias="word", keep=["doc_id"])


@register("row_filter", oracle="SELECT event_id, value FROM events WHERE value > 100")
def row_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return rows.filter_rows(e, F.col("value") > 100).select("event_id", "value")


@register("row_keys", oracle="SELECT o_custkey AS k FROM orders")
def row_keys(spark, sf_dir):
    return rows.keys(_orders_pairs(spark, sf_dir))


@register("row_values", oracle="SELECT o_totalprice AS v FROM orders")
def row_values(spark, sf_dir):
    return rows.values(_orders_pairs(spark, sf_dir))


@register("row_map_values", oracle="""
SELECT o_custkey AS k, CAST(length(o_orderpriority) AS BIGINT) AS v FROM orders
""")
def row_map_values(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    p = rows.project_keys(o, "o_custkey", "o_orderpriority")
    return rows.map_values(p, F.length("v").cast("long"))


@register("row_flat_map_values", oracle="""
SELECT c_custkey AS k, unnest(string_split(c_name, '#')) AS v FROM customer
""")
def row_flat_map_values(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    p = rows.project_keys(c, "c_custkey", "c_name")
    return rows.flat_map_values(p, F.split("v", "#", -1))


@register("row_key_by", oracle="""
SELECT CAST(year(o_orderdate) AS BIGINT) AS k, o_orderkey FROM orders
""")
def row_key_by(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.key_by(o, F.year("o_orderdate").cast("long")).select("k", "o_orderkey")


@register("row_vector_map", oracle="SELECT l_quantity * 4 AS y FROM lineitem")
def row_vector_map(spark, sf_dir):
    return rows.vector_map(load(spark, sf_dir, "lineitem"), "l_quantity", "x * 4")


@register("row_pipe", oracle=f"SELECT line AS value FROM ({DOC_LINES})")
def row_pipe(spark, sf_dir):
    from tessera.sources.text import lines_from

    lines = lines_from(load(spark, sf_dir, "documents"))
    return rows.pipe(lines, ["cat"], column="value")


@register("row_lookup", oracle="SELECT o_orderkey AS v FROM orders WHERE o_custkey = 10")
def row_lookup(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return rows.lookup(rows.project_keys(o, "o_custkey", "o_orderkey"), 10)


@register("row_lookup_bucketed", oracle="SELECT o_orderkey AS v FROM orders WHERE o_custkey = 10")
def row_lookup_bucketed(spark, sf_dir):
    """Lookup in a table bucketed by its key: one bucket of 32 is read."""
    pairs = rows.project_keys(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return rows.lookup(layout.write_bucketed(pairs, f"orders_pairs_{uuid.uuid4().hex[:8]}", 32, "k"), 10)


def _upper(s):
    return s.str.upper()


@register("row_map_udf", oracle="SELECT p_partkey, upper(p_name) AS value FROM part")
def row_map_udf(spark, sf_dir):
    # vectorised Python path (pandas_udf over Arrow batches)
    return rows.map_with(load(spark, sf_dir, "part"), _upper, "string", "p_name", keep=["p_partkey"])


def _name_parts(row):
    for piece in row["c_name"].split("#"):
        yield row["c_custkey"], piece


@register("row_flat_map_udf", oracle="""
SELECT c_custkey AS k, unnest(string_split(c_name, '#')) AS v FROM customer
""")
def row_flat_map_udf(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rows.flat_map_with(c, _name_parts, "k long, v string")


@F.udtf(returnType="word string, place long", useArrow=True)
class WordsOf:
    """The words of a text with their places."""

    def eval(self, text):
        for i, word in enumerate((text or "").split(" ")):
            yield word, i


@register("row_lateral_udtf", oracle="""
SELECT p_partkey, word, CAST(place - 1 AS BIGINT) AS place
FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)
""")
def row_lateral_udtf(spark, sf_dir):
    return rows.lateral(load(spark, sf_dir, "part").select("p_partkey", "p_name"), WordsOf, "p_name").drop("p_name")


@F.arrow_udtf(returnType="k long, n long, widest long")
class WidestGap:
    """Rows of a key and the widest gap between neighbours, from sorted batches; the last value is kept between them."""

    def __init__(self):
        self.k, self.n, self.last, self.widest = None, 0, None, None

    def eval(self, batch: pa.RecordBatch):
        values = batch.column(1)
        before = pa.concat_arrays([pa.array([self.last], values.type), values.slice(0, len(values) - 1)])
        gap = pc.max(pc.subtract(values, before)).as_py()
        self.widest = gap if self.widest is None or gap is not None and gap > self.widest else self.widest
        self.k, self.n, self.last = batch.column(0)[0].as_py(), self.n + len(values), values[-1].as_py()
        return iter(())

    def terminate(self):
        yield pa.table({"k": pa.array([self.k], pa.int64()), "n": pa.array([self.n], pa.int64()), "widest": pa.array([self.widest], pa.int64())})


@register("row_partition_udtf", oracle="""
SELECT k, count(*) AS n, max(gap) AS widest
FROM (SELECT o_custkey AS k, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders)
GROUP BY k
""")
def row_partition_udtf(spark, sf_dir):
    pairs = rows.project_keys(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return rows.over_partitions(pairs, WidestGap, ["k"], ["v"])
