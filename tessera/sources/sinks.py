"""Sinks. Columnar formats through the DataFrame writer; the
Hadoop key/value formats (SequenceFile, arbitrary OutputFormat classes)
through the pair-RDD writer, the only API that offers them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Hadoop class names for the key/value writers.
TEXT_OUTPUT_NEW = "org.apache.hadoop.mapreduce.lib.output.TextOutputFormat"
TEXT_OUTPUT_OLD = "org.apache.hadoop.mapred.TextOutputFormat"
SEQUENCE_OUTPUT = "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat"
HADOOP_TEXT = "org.apache.hadoop.io.Text"
GZIP_CODEC = "org.apache.hadoop.io.compress.GzipCodec"


def write_text(df: DataFrame, path: str, codec: str | None = None, column: str | None = None) -> None:
    """One UTF-8 line per row (empty strings stay empty lines)."""
    c = column or df.columns[0]
    w = df.select(F.col(c).cast("string").alias("value")).write.mode("overwrite")
    if codec:
        w = w.option("compression", codec)
    w.text(path)


def write_sequence(df: DataFrame, path: str, k: str = "k", v: str = "v", codec: str | None = None) -> None:
    """(k, v) as a Hadoop SequenceFile (Writable types from the Python values).

    Spark takes the types from a first row; without any, an empty text file of
    the same kind is written.
    """
    rdd = df.select(k, v).rdd.map(lambda r: (r[0], r[1]))
    if df.isEmpty():
        write_hadoop(df.select(F.col(k).cast("string"), F.col(v).cast("string")), path, SEQUENCE_OUTPUT, k, v, codec=codec)
        return
    rdd.saveAsSequenceFile(path, compressionCodecClass=codec)


def read_sequence(spark: SparkSession, path: str, schema: str = "k string, v string") -> DataFrame:
    """(k, v) of a SequenceFile, typed by ``schema``; an empty file gives no rows."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(tuple), schema)


def write_objects(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Typed columnar file (parquet / orc) in place of pickled objects."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_format(df: DataFrame, path: str, fmt: str, options: dict | None = None) -> None:
    """Any DataFrame data source by name (json, csv, parquet, orc, text …)."""
    df.write.mode("overwrite").format(fmt).options(**(options or {})).save(path)


def write_dataset(df: DataFrame, conf: dict) -> None:
    """Target and format from one configuration dict: ``path``, ``format``,
    remaining keys are writer options."""
    conf = dict(conf)
    path, fmt = conf.pop("path"), conf.pop("format", "parquet")
    write_format(df, path, fmt, conf)


def write_hadoop(df: DataFrame, path: str, output_format: str, k: str = "k", v: str = "v", new_api: bool = True,
                 key_class: str = HADOOP_TEXT, value_class: str = HADOOP_TEXT, key_converter: str | None = None,
                 value_converter: str | None = None, conf: dict[str, str] | None = None, codec: str | None = None) -> None:
    """(k, v) through any Hadoop output format class, with converters and configuration.

    ``new_api`` says whether the class is of the mapreduce (new) or mapred (old) kind.
    """
    rdd = df.select(k, v).rdd.map(tuple)
    if new_api:
        conf = {**(conf or {}), **({"mapreduce.output.fileoutputformat.compress": "true", "mapreduce.output.fileoutputformat.compress.codec": codec} if codec else {})}
        rdd.saveAsNewAPIHadoopFile(path, output_format, key_class, value_class, key_converter, value_converter, conf or None)
    else:
        rdd.saveAsHadoopFile(path, output_format, key_class, value_class, key_converter, value_converter, conf, codec)


def write_hadoop_dataset(df: DataFrame, conf: dict[str, str], k: str = "k", v: str = "v", new_api: bool = True,
                         key_converter: str | None = None, value_converter: str | None = None) -> None:
    """(k, v) to where and as what a Hadoop configuration alone says: format, folder, codec, key and value classes.

    ``hadoop_conf`` makes such a configuration for the usual settings.
    """
    rdd = df.select(k, v).rdd.map(tuple)
    save = rdd.saveAsNewAPIHadoopDataset if new_api else rdd.saveAsHadoopDataset
    save(conf, key_converter, value_converter)


def hadoop_conf(path: str, output_format: str, key_class: str = HADOOP_TEXT, value_class: str = HADOOP_TEXT,
                codec: str | None = None, new_api: bool = True) -> dict[str, str]:
    """The configuration of an output by the names that the new (mapreduce) or old (mapred) kind reads."""
    if new_api:
        conf = {"mapreduce.job.outputformat.class": output_format, "mapreduce.job.output.key.class": key_class,
                "mapreduce.job.output.value.class": value_class, "mapreduce.output.fileoutputformat.outputdir": path}
        return {**conf, "mapreduce.output.fileoutputformat.compress": "true", "mapreduce.output.fileoutputformat.compress.codec": codec} if codec else conf
    conf = {"mapred.output.format.class": output_format, "mapred.output.key.class": key_class,
            "mapred.output.value.class": value_class, "mapred.output.dir": path}
    return {**conf, "mapred.output.compress": "true", "mapred.output.compression.codec": codec} if codec else conf


def write_hadoop_text(df: DataFrame, path: str, k: str = "k", v: str = "v", new_api: bool = True,
                      codec: str | None = None) -> None:
    """(k, v) through Hadoop's TextOutputFormat: ``key<TAB>value`` lines."""
    pairs = df.select(F.col(k).cast("string").alias("k"), F.col(v).cast("string").alias("v"))
    write_hadoop(pairs, path, TEXT_OUTPUT_NEW if new_api else TEXT_OUTPUT_OLD, new_api=new_api, codec=codec)


def for_each(df: DataFrame, fn: Callable[[Row], None]) -> None:
    """Side effect per row (use an accumulator to observe results)."""
    df.foreach(fn)


def for_each_partition(df: DataFrame, fn: Callable[[Iterable[Row]], None]) -> None:
    df.foreachPartition(fn)
