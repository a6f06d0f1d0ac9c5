"""Word count over text.

The input is any frame with a text column; each text is a "file" whose lines
are what a text-file reader yields. Both totals are computed per text without
materialising lines or tokens, then summed with a partial + final aggregate,
so the only shuffle carries one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import space_run_count, split_token_count, tokens_of


def word_count_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Total of ``line.split(' ')`` tokens over all lines, empty tokens included."""
    return texts.select(text_col).agg(
        F.coalesce(F.sum(split_token_count(text_col)), F.lit(0)).cast("long").alias("split_tokens")
    )


def word_count_runs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Total of maximal non-space runs over all lines (ASCII space only)."""
    return texts.select(text_col).agg(
        F.coalesce(F.sum(space_run_count(text_col)), F.lit(0)).cast("long").alias("space_runs")
    )


def word_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): frequency of every ``split(' ')`` token.

    explode → partial HashAggregate per task → shuffle of (word, partial n)
    only, so a very frequent word costs one row per task, not one per use.
    """
    words = texts.select(text_col).select(F.explode(tokens_of(text_col)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
