"""Input generators, re-aimed as Spark jobs.

Each generator derives its rows from the rows of a driving frame (one point
or pair per key row), so the output scales with the data and every value is
a reproducible function of (key, seed) — identical for any partitioning
and on task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, uniform


def gen_points(keys: DataFrame, key: str, dims: int = 3, low: float = 0.1, high: float = 10.0,
               seed: int = 0) -> DataFrame:
    """(key, p): one point per key row, coordinates uniform in [low, high)."""
    coords = [uniform(key, F.lit(d), low=low, high=high, seed=seed) for d in range(dims)]
    return keys.select(col(key), F.array(*coords).alias("p"))


def gen_int_points(keys: DataFrame, key: str, dims: int = 4, low: float = 0.1, high: float = 10.0,
                   seed: int = 0) -> DataFrame:
    """As ``gen_points`` truncated to int: values 0..9 for the default range."""
    coords = [uniform(key, F.lit(d), low=low, high=high, seed=seed).cast("int") for d in range(dims)]
    return keys.select(col(key), F.array(*coords).alias("p"))


def gen_pairs(keys: DataFrame, key: str, low: float = 0.0, high: float = 10.0, seed: int = 0,
              ladder: int = 0) -> DataFrame:
    """(key, k, v) uniform pairs; with ``ladder`` = s > 0 the sizes
    base×1 … base×s are produced at once: for every key row and step j the
    frame has j rows (``size_step`` = j, ``rep`` = 1..j)."""
    if ladder:
        x = keys.select(col(key), F.explode(F.sequence(F.lit(1), F.lit(int(ladder)))).alias("size_step"))
        x = x.select("*", F.explode(F.sequence(F.lit(1), F.col("size_step"))).alias("rep"))
        parts: list[Column | str] = [key, "size_step", "rep"]
        return x.select(col(key), "size_step", "rep",
                        uniform(*parts, F.lit("k"), low=low, high=high, seed=seed).alias("k"),
                        uniform(*parts, F.lit("v"), low=low, high=high, seed=seed).alias("v"))
    return keys.select(col(key),
                       uniform(key, F.lit("k"), low=low, high=high, seed=seed).alias("k"),
                       uniform(key, F.lit("v"), low=low, high=high, seed=seed).alias("v"))


def replicate(df: DataFrame, times: int, copy_col: str = "copy") -> DataFrame:
    """The frame repeated ``times`` times (explode of a sequence: a narrow
    operation per row, no join)."""
    return df.select(F.explode(F.sequence(F.lit(1), F.lit(int(times)))).alias(copy_col), *df.columns)
