"""Partition-wise operators and physical layout.

Per-partition user code runs through Arrow batches (``mapInArrow``); all
layout changes are plain repartition / coalesce / range operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

ArrowFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def map_partitions(df: DataFrame, fn: ArrowFn, schema: str) -> DataFrame:
    """``fn`` gets the iterator of Arrow batches of one partition."""
    return df.mapInArrow(fn, schema)


def map_partitions_with_index(df: DataFrame, fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                              schema: str) -> DataFrame:
    """As ``map_partitions``; ``fn`` also gets the partition number."""

    def run(batches):
        return fn(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(run, schema)


def glom(df: DataFrame, out: str = "rows") -> DataFrame:
    """One row per partition: (partition, array of its rows in order).

    Built by the task that reads the partition, without a shuffle; an empty
    partition gives an empty array.
    """
    shape = StructType([StructField("partition", IntegerType()), StructField(out, ArrayType(df.schema))])
    names = list(df.columns)

    def gather(batches):
        batches = list(batches)
        rows = [pa.StructArray.from_arrays(b.columns, names=names) for b in batches]
        values = pa.concat_arrays(rows) if rows else pa.array([], pa.struct([]))
        one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) if len(values) else pa.array([[]], arrow_shape.field(out).type)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), one.cast(arrow_shape.field(out).type)], names=["partition", out])

    arrow_shape = to_arrow_schema(shape)
    return df.mapInArrow(gather, shape)


def partition_profile(df: DataFrame) -> DataFrame:
    """(partition, rows) for every non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def num_partitions(df: DataFrame) -> int:
    """Number of partitions, an action: adaptive plans run their shuffles to know it."""
    return df.rdd.getNumPartitions()


def partition_by(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """Hash-partition on the key: every key lands in exactly one partition."""
    return df.repartition(int(n), *keys)


def partition_by_id(df: DataFrame, n: int, partition_expr: Column | str) -> DataFrame:
    """Custom partition function: the expression gives the partition number
    (taken modulo n, negative values wrap)."""
    e = partition_expr if isinstance(partition_expr, Column) else F.expr(partition_expr)
    return df.repartitionById(int(n), F.pmod(e.cast("long"), F.lit(int(n))).cast("int"))


def repartition_and_sort_within(df: DataFrame, n: int, partition_expr: Column | str,
                                sort_by: Sequence[str | Column], ascending: bool = True) -> DataFrame:
    """Partition with a function, then sort rows inside each partition."""
    order = [(F.col(c) if isinstance(c, str) else c) for c in sort_by]
    order = [o.asc_nulls_first() if ascending else o.desc_nulls_last() for o in order]
    return partition_by_id(df, n, partition_expr).sortWithinPartitions(*order)


def repartition(df: DataFrame, n: int) -> DataFrame:
    """Full shuffle to n partitions (round robin)."""
    return df.repartition(int(n))


def coalesce(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(int(n))


def write_bucketed(df: DataFrame, table: str, n: int, *keys: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed (and sorted) by ``keys`` into ``n``
    buckets under the shared folder, and return it.

    Two tables bucketed the same way on their join keys join without a
    shuffle in any later job — the cross-job form of "skip the shuffle when
    the partitioner is equal". The files live in the shared checkpoint folder and stay, while the name is
    dropped again: the returned frame knows files and buckets.
    """
    from tessera.session import shared_dir

    spark = df.sparkSession
    where = path or shared_dir(spark, f"bucketed-{table}")
    (df.write.mode("overwrite").bucketBy(int(n), *keys).sortBy(*keys)
     .option("path", where).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: only the name goes
    return out
