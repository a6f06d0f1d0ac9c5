"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir


def stored(df: DataFrame, purpose: str, made: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Later stages then read one fixed set of rows, whichever executors are lost
    in between, and no lineage reaches past the files. The folder is added to
    ``made``, for ``session.remove``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... among the rows of a key (not null).

    ``rows`` has ``part``, the partition that a row was read in. Rows are
    counted inside a part, parts follow each other, so no task sorts more of a
    hot key than one part of it. Which row of a key gets which number is open.
    """
    inside = Window.partitionBy(key, "part").orderBy(key)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = counts.select(key, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    placed = rows.withColumn("place_in_part", F.row_number().over(inside) - 1).join(before, [key, "part"])
    return placed.withColumn(name, F.col("before") + F.col("place_in_part")).drop("before", "place_in_part")


def others(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` whose names don't clash with ``taken`` (in any case)."""
    names = {n.lower() for n in taken}
    return [c for c in df.columns if c.lower() not in names]


def col(name: str):
    """Column by its exact name, also one with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(array) -> list[bytes | None]:
    """Byte strings of an Arrow text or binary column."""
    return array.cast(pa.binary()).to_pylist()


def filter_batches(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df.mapInArrow(keep)`` with the schema of ``df``, whatever its columns are called.

    ``keep`` sees the columns in their order; Spark itself looks columns up by
    name there, which fails for names with dots.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)
