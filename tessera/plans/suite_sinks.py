"""Registered queries: sinks. Each query writes the whole input
to a fresh folder under the shared checkpoint folder, reads it back and
returns the rows read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.oracle_sql import DOC_LINES
from tessera.plans.registry import register
from tessera.session import shared_dir
from tessera.sources import sinks
from tessera.sources.tables import load
from tessera.sources.text import lines_from

_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


@register("sink_text", oracle=f"SELECT line AS value FROM ({DOC_LINES})")
def sink_text(spark, sf_dir):
    path = shared_dir(spark, "text")
    sinks.write_text(lines_from(load(spark, sf_dir, "documents")), path)
    return spark.read.text(path)


@register("sink_text_gzip", oracle=f"SELECT line AS value FROM ({DOC_LINES})")
def sink_text_gzip(spark, sf_dir):
    path = shared_dir(spark, "textgz")
    sinks.write_text(lines_from(load(spark, sf_dir, "documents")), path, codec="gzip")
    return spark.read.text(path)


@register("sink_sequencefile", oracle="SELECT o_orderkey AS k, o_orderpriority AS v FROM orders")
def sink_sequencefile(spark, sf_dir):
    path = shared_dir(spark, "seq")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    sinks.write_sequence(o, path)
    back = sinks.read_sequence(spark, path, "k long, v string")
    return back.select(F.col("k").cast("long").alias("k"), F.col("v").cast("string").alias("v"))


@register("sink_parquet_roundtrip", oracle=_ORDERS_SQL)
def sink_parquet_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "parquet")
    sinks.write_objects(load(spark, sf_dir, "orders").select(*_ORDER_COLS), path, "parquet")
    return spark.read.parquet(path)


@register("sink_orc_roundtrip", oracle=_ORDERS_SQL)
def sink_orc_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "orc")
    sinks.write_objects(load(spark, sf_dir, "orders").select(*_ORDER_COLS), path, "orc")
    return spark.read.orc(path)


def _hadoop_text(spark, sf_dir, new_api: bool, codec=None):
    path = shared_dir(spark, "hadoop")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    sinks.write_hadoop_text(c, path, new_api=new_api, codec=codec)
    parts = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("k"), parts[1].alias("v"))


@register("sink_newapi_hadoop_file", oracle="SELECT c_custkey AS k, c_name AS v FROM customer")
def sink_newapi_hadoop_file(spark, sf_dir):
    return _hadoop_text(spark, sf_dir, True)


@register("sink_hadoop_file", oracle="SELECT c_custkey AS k, c_name AS v FROM customer")
def sink_hadoop_file(spark, sf_dir):
    return _hadoop_text(spark, sf_dir, False, codec=sinks.GZIP_CODEC)


def _hadoop_by_conf(spark, sf_dir, new_api, codec=None):
    path = shared_dir(spark, "hadoop-conf")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("v"))
    form = sinks.TEXT_OUTPUT_NEW if new_api else sinks.TEXT_OUTPUT_OLD
    sinks.write_hadoop_dataset(c, sinks.hadoop_conf(path, form, codec=codec, new_api=new_api), new_api=new_api)
    parts = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("k"), parts[1].alias("v"))


@register("sink_newapi_hadoop_dataset", oracle="SELECT c_custkey AS k, c_name AS v FROM customer")
def sink_newapi_hadoop_dataset(spark, sf_dir):
    return _hadoop_by_conf(spark, sf_dir, True, sinks.GZIP_CODEC)


@register("sink_hadoop_dataset", oracle="SELECT c_custkey AS k, c_name AS v FROM customer")
def sink_hadoop_dataset(spark, sf_dir):
    return _hadoop_by_conf(spark, sf_dir, False)


@register("sink_json_roundtrip", oracle=_ORDERS_SQL)
def sink_json_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "json")
    sinks.write_dataset(load(spark, sf_dir, "orders").select(*_ORDER_COLS), {"path": path, "format": "json"})
    return spark.read.schema(_ORDERS_SCHEMA).json(path)


@register("sink_csv_roundtrip", oracle=_ORDERS_SQL)
def sink_csv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "csv")
    sinks.write_dataset(load(spark, sf_dir, "orders").select(*_ORDER_COLS),
                        {"path": path, "format": "csv", "header": "true"})
    return spark.read.schema(_ORDERS_SCHEMA).option("header", "true").csv(path)


@register("act_foreach", oracle="SELECT count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS key_total FROM orders")
def act_foreach(spark, sf_dir):
    sc = spark.sparkContext
    rows, total = sc.accumulator(0), sc.accumulator(0)

    def visit(r):
        rows.add(1)
        total.add(r["o_custkey"])

    sinks.for_each(load(spark, sf_dir, "orders").select("o_custkey"), visit)
    return spark.createDataFrame([(rows.value, total.value)], "rows long, key_total long")


@register("act_foreach_partition", oracle="SELECT count(*) AS rows FROM lineitem")
def act_foreach_partition(spark, sf_dir):
    sc = spark.sparkContext
    rows = sc.accumulator(0)

    def visit(it):
        n = 0
        for _ in it:
            n += 1
        rows.add(n)

    sinks.for_each_partition(load(spark, sf_dir, "lineitem").select("l_orderkey"), visit)
    return spark.createDataFrame([(rows.value,)], "rows long")
