"""Sorting of numeric key–value pairs (R4): parse the pair text, sort by key.

The sort is a range-partitioned global sort (no collect to a driver or a
single device); the output carries each pair's global position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.order import ranked
from tessera.sources.text import format_pairs, pairs_of


def pair_lines(df: DataFrame, k: str, v: str) -> DataFrame:
    """Two numeric columns as ``"(k, v)"`` text lines (the pair file format)."""
    return format_pairs(df, k, v)


def sort_pairs(lines: DataFrame, column: str = "value", num_partitions: int | None = None) -> DataFrame:
    """(idx, k, v): pairs parsed from text, globally sorted by key (then value)."""
    return ranked(pairs_of(lines, column), ["k", "v"], True, "idx", num_partitions)
