"""Set and bag operations. Whole-row comparisons are null-safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by position, duplicates kept (no shuffle); names are those of ``a``."""
    return a.union(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both (NULL equals NULL).

    Spark plans a semi join and one aggregate; the right side is reduced to
    its distinct rows first, so that a hot row there meets the left side once.
    """
    return a.intersect(b.distinct())


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag difference: every row of ``a`` (duplicates kept) not in ``b``.

    Not EXCEPT DISTINCT and not EXCEPT ALL: a null-safe anti join on all
    columns against the distinct rows of ``b``.
    """
    rb = b.distinct()
    rb = rb.select(*[F.col(c).alias("__s_" + c) for c in rb.columns])
    cond = None
    for c in a.columns:
        e = a[c].eqNullSafe(rb["__s_" + c])
        cond = e if cond is None else cond & e
    return a.join(rb, cond, "left_anti")


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
