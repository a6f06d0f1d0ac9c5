"""Sorting, limits and top-k.

Global sorts are range-partitioned by Spark (sampled bounds) and sorted
inside partitions; adaptive execution merges small ranges. The input position is appended to the sort key, so a key
shared by a third of the rows is still spread over many range partitions,
and equal keys keep their input order (a stable sort).

Top-k and take-ordered plan as TakeOrderedAndProject: a bounded heap of k
rows per task, then a merge of k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, float32
from tessera.operators.position import row_index, sorted_partitions

_IN = "__tessera_in"


def _order(keys: Sequence[str | Column], ascending: bool) -> list[Column]:
    out = []
    for k in keys:
        c = col(k)
        out.append(c.asc_nulls_first() if ascending else c.desc_nulls_last())
    return out


def sort_by_key(df: DataFrame, keys: str | Sequence[str | Column] = "k", ascending: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Globally sorted frame: ascending puts NULL first, descending last."""
    ks = [keys] if isinstance(keys, (str, Column)) else list(keys)
    x = sorted_partitions(df, _order(ks, ascending), ascending, num_partitions)
    return x.drop(_IN)


def sort_by(df: DataFrame, expr: Column | str, ascending: bool = True,
            num_partitions: int | None = None) -> DataFrame:
    """Sort by a computed key (the key is not kept)."""
    e = expr if isinstance(expr, Column) else F.expr(expr)
    return sort_by_key(df.withColumn("__sort_key", e), ["__sort_key"], ascending, num_partitions).drop("__sort_key")


def ranked(df: DataFrame, keys: Sequence[str | Column], ascending: bool = True, index_col: str = "idx",
           num_partitions: int | None = None) -> DataFrame:
    """Sorted frame with its global 0-based position (``idx``)."""
    return row_index(df, _order(keys, ascending), ascending, index_col, num_partitions)


def top(df: DataFrame, n: int, keys: Sequence[str | Column]) -> DataFrame:
    """The n largest rows, descending (bounded heap per task)."""
    return df.orderBy(*_order(keys, False)).limit(int(n))


def take_ordered(df: DataFrame, n: int, keys: Sequence[str | Column]) -> DataFrame:
    """The n smallest rows, ascending."""
    return df.orderBy(*_order(keys, True)).limit(int(n))


def take(df: DataFrame, n: int) -> DataFrame:
    """First n rows in partition order.

    Collected, this scans partition after partition until it has n rows; as
    part of a larger plan every partition offers its first n rows.
    """
    return df.limit(int(n))


def first(df: DataFrame, order: Sequence[str | Column] | None = None, strict: bool = False) -> DataFrame:
    """First row (in ``order`` if given); ``strict`` raises on empty input."""
    out = (df.orderBy(*_order(order, True)) if order else df).limit(1)
    if strict and out.isEmpty():
        raise ValueError("there is no first row in an empty frame")
    return out


def is_empty(df: DataFrame, out: str = "is_empty") -> DataFrame:
    """One row: whether the frame has no row.

    An action: it looks for one row, in more partitions each time it finds none.
    """
    return df.sparkSession.range(1).select(F.lit(df.isEmpty()).alias(out))


def _sorted(x: DataFrame, keys: list[str], ascending: bool, index_col: str | None,
            num_partitions: int | None = None) -> DataFrame:
    if index_col:
        return ranked(x, keys, ascending, index_col, num_partitions)
    return sort_by_key(x, keys, ascending, num_partitions)


def sort_values(df: DataFrame, column: str, out: str = "value", index_col: str | None = None) -> DataFrame:
    """Scalars as float64, ascending (``index_col`` adds the global position)."""
    return _sorted(df.select(col(column).cast("double").alias(out)), [out], True, index_col)


def sort_int32_by_key(df: DataFrame, k: str = "k", v: str = "v", descending: bool = False,
                      index_col: str | None = None, then_by_value: bool = False) -> DataFrame:
    """(k, v) truncated to int32 (toward zero), sorted by k (then v if asked)."""
    x = df.select(col(k).cast("int").alias("k"), col(v).cast("int").alias("v"))
    return _sorted(x, ["k", "v"] if then_by_value else ["k"], not descending, index_col)


def sort_float32_by_key(df: DataFrame, k: str = "k", v: str = "v", descending: bool = False,
                        index_col: str | None = None, then_by_value: bool = False) -> DataFrame:
    """(k, v) rounded to float32 (both, as the device sort did), sorted by k."""
    x = df.select(float32(k).alias("k"), float32(v).alias("v"))
    return _sorted(x, ["k", "v"] if then_by_value else ["k"], not descending, index_col)


def sort_range_partitioned(df: DataFrame, num_partitions: int, k: str = "k", v: str = "v",
                           ascending: bool = True, precision: str = "float32",
                           index_col: str | None = None, then_by_value: bool = False) -> DataFrame:
    """Range-partition into ``num_partitions`` and sort each partition: the
    concatenation of partitions is globally ordered in the asked direction.
    With ``index_col`` the position is read off that layout (partition
    offsets + position inside the partition)."""
    cast = float32 if precision == "float32" else (lambda c: col(c).cast("double"))
    x = df.select(cast(k).alias("k"), cast(v).alias("v"))
    return _sorted(x, ["k", "v"] if then_by_value else ["k"], ascending, index_col, num_partitions)
