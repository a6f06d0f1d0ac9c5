"""Text sources: lines, vectors, pairs.

``read_*`` take a path of text files; ``*_of`` take a frame that already
holds text (e.g. the documents table) so the same parsers apply to both.
Parsers are typed SQL expressions: a malformed number fails the query
(ANSI cast / FAILFAST), as the original ``float()`` / ``eval`` would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import col, lines_of


_NUMBER = r"[ \t]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t]*"
PAIR = rf"^[ \t]*\({_NUMBER},{_NUMBER}\)[ \t]*$"


def read_lines(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """One row (``value``) per line of the text files under ``path``.

    Files are read in splits of ``spark.sql.files.maxPartitionBytes``; a
    smaller ``split_bytes`` gives more partitions without a shuffle.
    """
    reader = spark.read
    if split_bytes:
        reader = reader.option("maxPartitionBytes", str(int(split_bytes)))
    return reader.text(path)


def lines_from(texts: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of texts held in a column (text-file line semantics)."""
    return texts.select(*keep, F.explode(lines_of(text_col)).alias("value"))


def vectors_of(df: DataFrame, column: str = "value", out: str = "p", keep: tuple[str, ...] = ()) -> DataFrame:
    """``"a b c"`` → array<double>; an empty or non-numeric token is an error."""
    arr = F.split(col(column), " ", -1)
    parsed = F.transform(arr, lambda t: t.cast("double"))
    # strict: a token that does not parse fails the task instead of becoming NULL
    checked = F.when(F.exists(parsed, lambda x: x.isNull()),
                     F.raise_error(F.concat(F.lit("bad vector: "), col(column)))).otherwise(parsed)
    return df.select(*keep, checked.cast("array<double>").alias(out))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return vectors_of(read_lines(spark, path))


def pairs_of(df: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``"(a, b)"`` → (k double, v double); a malformed line fails the query.

    The whole line must match one pattern: two numbers around a comma, in
    parentheses, with blanks only around the numbers.
    """
    line = col(column)
    checked = F.when(line.rlike(PAIR), line).otherwise(F.raise_error(F.concat(F.lit("bad pair: "), F.coalesce(line, F.lit("NULL")))))
    number = lambda i: F.regexp_extract(checked, PAIR, i).cast("double")
    return df.select(*keep, number(1).alias("k"), number(2).alias("v"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return pairs_of(read_lines(spark, path))


def format_pairs(df: DataFrame, k: str = "k", v: str = "v", out: str = "value") -> DataFrame:
    """(k, v) → ``"(k, v)"`` text lines, the pair file format."""
    return df.select(F.concat(F.lit("("), col(k).cast("string"), F.lit(", "), col(v).cast("string"), F.lit(")")).alias(out))


def format_vectors(df: DataFrame, column: str = "p", out: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """array → space-separated text, the point file format."""
    return df.select(*keep, F.array_join(F.transform(col(column), lambda x: x.cast("string")), " ").alias(out))
