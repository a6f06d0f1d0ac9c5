"""Histograms.

A histogram is described by one Spark table of buckets (bucket, low, high),
made from the column's range or from the caller's edges. Every value is
placed by an expression over the edges, counted with a partial aggregate, and
the counts are joined to the bucket table, so empty buckets show 0.

Buckets hold low <= x < high, the last one also x = high. NULL, NaN and
values outside are not counted. Values and edges are compared in the type of
the column: integers stay integers however large.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tessera.functions.exprs import col


class HistogramError(ValueError):
    """The buckets asked for can't be made."""


def _values(df: DataFrame, column: str | Column) -> DataFrame:
    values = df.select(col(column).alias("x")).where(F.col("x").isNotNull())
    if isinstance(values.schema["x"].dataType, (DoubleType, FloatType)):
        values = values.where(~F.isnan("x"))
    return values


def _counted(buckets: DataFrame, places: DataFrame) -> DataFrame:
    """Bucket table with the number of rows that ``places`` (bucket) puts into each."""
    counts = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    joined = buckets.join(counts, "bucket", "left")
    return joined.select("bucket", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def histogram_even(df: DataFrame, column: str | Column, buckets: int) -> DataFrame:
    """(bucket, low, high, count) of ``buckets`` equal widths over the column's range.

    The range is the operator's first pass: two numbers reach the driver. The
    bucket table is made by Spark, so a large number of buckets never passes
    the driver. A column with a single value has one bucket.
    """
    if buckets < 1:
        raise HistogramError(f"a histogram has at least one bucket, not {buckets}")
    values = _values(df, column).select(F.col("x").cast("double").alias("x"))
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        raise HistogramError("the column has no values to take a range from")
    n = buckets if high > low else 1
    width = (high - low) / n
    if width in (float("inf"), float("-inf")) or width != width:
        raise HistogramError(f"the range from {low} to {high} has no finite width")
    at = lambda i: i.cast("double") * F.lit(width) + F.lit(low)
    number = F.col("id")
    table = df.sparkSession.range(n).select(
        number.cast("int").alias("bucket"), at(number).alias("low"),
        F.when(number == n - 1, F.lit(high)).otherwise(at(number + 1)).alias("high"),
    )
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(n - 1)) if n > 1 else F.lit(0)
    return _counted(table, values.select(place.cast("int").alias("bucket")))


def _kind(edges: list) -> str:
    """SQL type of the edges."""
    kinds = {type(e) for e in edges}
    if kinds <= {int}:
        return "bigint"
    if kinds <= {int, float}:
        return "double"
    if kinds <= {int, Decimal}:
        return "decimal(38,18)"
    for python, sql in ((str, "string"), (datetime, "timestamp"), (date, "date")):
        if kinds == {python}:
            return sql
    raise HistogramError(f"edges of types {sorted(k.__name__ for k in kinds)} can't be compared with each other")


def _place(x: Column, edges: list[Column], first: int, last: int) -> Column:
    """Number of the bucket from ``first`` to ``last`` that holds x: a comparison
    for each halving, all in generated code."""
    if first == last:
        return F.lit(first)
    middle = (first + last + 1) // 2
    return F.when(x < edges[middle], _place(x, edges, first, middle - 1)).otherwise(_place(x, edges, middle, last))


def histogram_edges(df: DataFrame, column: str | Column, edges: Sequence) -> DataFrame:
    """(bucket, low, high, count) for edges given in strictly rising order.

    Edges are numbers, texts, dates or timestamps. Whole edges over an
    integer column are compared as integers; edges come back in their type.
    """
    edges = list(edges)
    if len(edges) < 2:
        raise HistogramError("two edges make a bucket, fewer don't")
    if any(e is None or e != e for e in edges):
        raise HistogramError("an edge is missing or not a number")
    kind = _kind(edges)
    wrong = next((i for i, (a, b) in enumerate(pairwise(edges)) if not a < b), None)
    if wrong is not None:
        raise HistogramError(f"edge {edges[wrong + 1]!r} does not rise above {edges[wrong]!r} before it")
    literals = [F.lit(e).cast(kind) for e in edges]
    values = _values(df, column)
    if kind == "string":
        values = values.select(F.col("x").cast("string").alias("x"))
    x = F.col("x")
    inside = values.where((x >= literals[0]) & (x <= literals[-1]))
    table = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairwise([float(e) for e in edges] if kind == "double" else edges))],
        f"bucket int, low {kind}, high {kind}",
    )
    return _counted(table, inside.select(_place(x, literals, 0, len(edges) - 2).alias("bucket")))
