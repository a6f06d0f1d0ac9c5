"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line terminators recognised by Hadoop's text reader, and the
# only word separator of the word-count programs (ASCII space, not \s).
LINE_BREAK = r"\r\n|\r|\n"
WORD_SEP = " "

TWO_POW_52 = 4503599627370496.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# text
# --------------------------------------------------------------------------

def ends_with_break(text: str | Column) -> Column:
    t = col(text)
    return F.endswith(t, F.lit("\n")) | F.endswith(t, F.lit("\r"))


def normalize_breaks(text: str | Column) -> Column:
    """Every line terminator (\r\n, \r, \n) as a single \n; literal
    replacements only (no regular expression)."""
    return F.translate(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), "\r", "\n")


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def line_count(text: str | Column) -> Column:
    """Number of lines a text-file reader yields for ``text``.

    Empty text has no line; otherwise one more than the terminators, minus a
    terminator that ends the text.
    """
    t = col(text)
    breaks = _count_char(normalize_breaks(t), "\n")
    return F.when(t == "", F.lit(0)).otherwise(breaks + 1 - ends_with_break(t).cast("int"))


def space_count(text: str | Column) -> Column:
    return _count_char(col(text), WORD_SEP)


def flat_words(text: str | Column) -> Column:
    """The text with every line terminator turned into one space.

    Texts without a carriage return (the common case) take one literal
    replace; the others are normalised first.
    """
    t = col(text)
    return F.when(F.instr(t, "\r") > 0, F.translate(normalize_breaks(t), "\n", " ")).otherwise(
        F.replace(t, F.lit("\n"), F.lit(" ")))


def split_token_count(text: str | Column) -> Column:
    """Σ over the lines of ``len(line.split(' '))``.

    Joining the lines with a space and splitting once on that literal
    character (the JVM's single-character fast path) yields the same
    tokens; a final terminator does not open another line.
    """
    t = col(text)
    n = F.size(F.split(flat_words(t), WORD_SEP, -1)) - ends_with_break(t).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(n).cast("long")


def space_run_count(text: str | Column) -> Column:
    """Σ over the lines of the maximal runs of non-space characters."""
    return F.regexp_count(col(text), F.lit(r"[^ \r\n]+")).cast("long")


def _drop_final_empty(arr: Column, text: Column) -> Column:
    """A final terminator leaves one trailing empty piece: drop it."""
    return F.when(ends_with_break(text), F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def lines_of(text: str | Column) -> Column:
    """Array of the lines of ``text`` (text-file semantics)."""
    t = col(text)
    parts = F.split(normalize_breaks(t), "\n", -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(_drop_final_empty(parts, t))


def tokens_of(text: str | Column) -> Column:
    """All ``split(' ')`` tokens of all lines of ``text``, empty ones kept.

    Terminators become spaces, so the split is on one literal character
    (Java's single-character fast path, no regular expression).
    """
    t = col(text)
    parts = F.split(flat_words(t), WORD_SEP, -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(_drop_final_empty(parts, t))


# --------------------------------------------------------------------------
# reproducible pseudo-random numbers
# --------------------------------------------------------------------------

def unit_hash(*parts: str | Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from the md5 of the parts and a seed.

    The same value is computable by any SQL engine that has md5 (the oracle
    does it with ``('0x' || substr(md5(s), 1, 13))::BIGINT / 2^52``), and it
    does not depend on partitioning, so samples are reproducible.
    """
    s = F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)


def uniform(*parts: str | Column, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    return unit_hash(*parts, seed=seed) * F.lit(float(high - low)) + F.lit(float(low))


def float32(c: str | Column) -> Column:
    """Round a number to single precision (and back to double for output)."""
    return col(c).cast("float").cast("double")
