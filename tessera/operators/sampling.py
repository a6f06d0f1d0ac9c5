"""Sampling and bounded estimates.

Two flavours: Spark's own samplers (``df.sample`` etc., fast, seeded per
partition) and hash samplers, where a row is kept when a uniform number
derived from its key and the seed falls under the fraction. Hash samples do
not depend on partitioning, are identical in any SQL engine with md5, and
survive task retries unchanged.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, unit_hash
from tessera.operators.position import row_index, zip_with_index

# Two-sided normal quantiles for the usual confidence levels.
Z_FOR_CONFIDENCE = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054,
                    0.99: 2.5758293035489004}


def _check_fraction(fraction: float) -> None:
    if fraction < 0:
        raise ValueError("fraction must be >= 0")


def sample(df: DataFrame, fraction: float, seed: int = 0, with_replacement: bool = False) -> DataFrame:
    """Bernoulli (or Poisson, with replacement) sample by Spark's sampler."""
    _check_fraction(fraction)
    return df.sample(withReplacement=with_replacement, fraction=fraction, seed=seed)


#: Mean of one Poisson draw; larger means are sums of independent draws.
DRAW_MEAN = 16.0


def poisson_thresholds(mean: float) -> list[float]:
    """Cumulative Poisson probabilities P(K <= j), j = 0, 1, … until the
    remaining tail is below 1e-15 (the inverse-CDF table of one draw)."""
    if not 0 <= mean <= DRAW_MEAN:
        raise ValueError(f"one draw has a mean from 0 to {DRAW_MEAN}")
    p = math.exp(-mean)
    c, j, out = p, 0, [p]
    while c < 1.0 - 1e-15 and p > 0:
        j += 1
        p *= mean / j
        if c + p == c:
            break
        c += p
        out.append(c)
    return out


def poisson_draw(u: Column, mean: float) -> Column:
    """Number of copies K ~ Poisson(mean) from a uniform u (inverse CDF as a
    CASE chain that stays in codegen)."""
    t = poisson_thresholds(mean)
    k = F.lit(len(t))
    for j in range(len(t) - 1, -1, -1):
        k = F.when(u < F.lit(t[j]), F.lit(j)).otherwise(k)
    return k


def poisson_copies(key: Sequence[str | Column], mean: float, seed: int) -> Column:
    """K ~ Poisson(mean) for any mean, derived from the key: a Poisson variable
    is the sum of independent ones, each drawn with a seed of its own."""
    draws = max(1, math.ceil(mean / DRAW_MEAN))
    if draws == 1:
        return poisson_draw(unit_hash(*key, seed=seed), mean)
    t = F.array(*[F.lit(x) for x in poisson_thresholds(mean / draws)])
    one = lambda i: F.size(F.filter(t, lambda c: c <= unit_hash(*key, F.concat(F.lit("draw"), i.cast("string")), seed=seed)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0), lambda acc, i: acc + one(i))


def _with_copies(df: DataFrame, k: Column, copy_col: str) -> DataFrame:
    x = df.withColumn("__k", k).where(F.col("__k") > 0)
    return x.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__k")


def sample_hash(df: DataFrame, fraction: float, key: Sequence[str | Column], seed: int = 0,
                with_replacement: bool = False, copy_col: str = "copy") -> DataFrame:
    """Reproducible sample by unit_hash(key, seed).

    Without replacement: keep a row when the uniform is below ``fraction``.
    With replacement: each row appears K ~ Poisson(fraction) times (column
    ``copy`` = 1..K), the draw also derived from the uniform.
    """
    _check_fraction(fraction)
    if with_replacement:
        return _with_copies(df, poisson_copies(key, float(fraction), seed), copy_col)
    return df.where(unit_hash(*key, seed=seed) < F.lit(float(fraction)))


def split_hash(df: DataFrame, weights: Sequence[float], key: Sequence[str | Column], seed: int = 0,
               split_col: str = "split") -> DataFrame:
    """Disjoint, complete split by normalised weights; adds the split number.

    ``[frame.where(split == i) for i …]`` gives the individual parts.
    """
    if any(w < 0 for w in weights):
        raise ValueError("weights must be >= 0")
    total = float(sum(weights))
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc)
    u = unit_hash(*key, seed=seed)
    s = F.lit(len(weights) - 1)
    for i in range(len(bounds) - 1, -1, -1):
        s = F.when(u < F.lit(bounds[i]), F.lit(i)).otherwise(s)
    return df.withColumn(split_col, s.cast("int"))


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Spark's own random split (sorted per partition, seeded)."""
    return df.randomSplit(list(weights), seed)


def take_sample(df: DataFrame, n: int, key: Sequence[str | Column], seed: int = 0) -> DataFrame:
    """Exactly min(n, size) distinct rows, uniformly: the n smallest hashes.

    A bounded heap of n rows per task (TakeOrderedAndProject).
    """
    if n < 0:
        raise ValueError(f"a sample of {n} rows can't be taken")
    h = unit_hash(*key, seed=seed)
    return df.withColumn("__h", h).orderBy("__h", *[col(k) for k in key]).limit(int(n)).drop("__h")


def take_sample_with_replacement(df: DataFrame, n: int, seed: int = 0, draw_col: str = "draw",
                                 order: Sequence[str | Column] | None = None) -> DataFrame:
    """Exactly n rows drawn with replacement.

    n draws of a uniform position 0..size-1 are joined to the dense index of
    the frame (a shuffle on a unique key); one extra count. Positions are in
    ``order`` when given (reproducible across partitionings), else in
    partition order.
    """
    if n < 0:
        raise ValueError(f"a sample of {n} rows can't be taken")
    size = df.count()
    if size == 0 or n == 0:
        return df.limit(0).withColumn(draw_col, F.lit(0).cast("long"))
    spark = df.sparkSession
    draws = spark.range(int(n)).select(
        F.col("id").alias(draw_col),
        F.least(F.floor(unit_hash("id", seed=seed) * F.lit(size)), F.lit(size - 1)).cast("long").alias("__pick"))
    indexed = row_index(df, list(order), index_col="__pick") if order else zip_with_index(df, "__pick")
    return draws.join(indexed, "__pick").drop("__pick")


def sample_by_key_hash(df: DataFrame, key_col: str, fractions: dict, key: Sequence[str | Column],
                       seed: int = 0, strict: bool = False, with_replacement: bool = False,
                       copy_col: str = "copy") -> DataFrame:
    """Stratified reproducible sample: per-stratum fraction from ``fractions``.

    A stratum missing from ``fractions`` keeps no row (``strict`` raises
    instead, checked by one aggregate over the distinct strata). With
    replacement a row of stratum s appears Poisson(fractions[s]) times.
    """
    for f in fractions.values():
        _check_fraction(f)
    if strict:
        missing = df.select(key_col).distinct().where(~F.col(key_col).isin(list(fractions))).limit(1).collect()
        if missing:
            raise KeyError(missing[0][0])
    u = unit_hash(*key, seed=seed)
    if with_replacement:
        k = F.lit(0)
        for stratum, f in fractions.items():
            k = F.when(F.col(key_col) == F.lit(stratum), poisson_copies(key, float(f), seed)).otherwise(k)
        return _with_copies(df, k, copy_col)
    m = F.create_map(*[x for kv in fractions.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
    frac = F.coalesce(F.element_at(m, F.col(key_col)), F.lit(0.0))
    return df.where(u < frac)


def sample_by_key(df: DataFrame, key_col: str, fractions: dict, seed: int = 0) -> DataFrame:
    """Spark's stratified sampler."""
    return df.sampleBy(key_col, fractions, seed)


# --------------------------------------------------------------------------
# bounded estimates from a hash sample
# --------------------------------------------------------------------------

def _z(confidence: float) -> float:
    if confidence in Z_FOR_CONFIDENCE:
        return Z_FOR_CONFIDENCE[confidence]
    # inverse normal CDF by bisection on erf (no scipy dependency)
    lo, hi = 0.0, 10.0
    target = confidence
    for _ in range(100):
        mid = (lo + hi) / 2
        if math.erf(mid / math.sqrt(2)) < target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def approx_stats(df: DataFrame, column: str | Column | None, key: Sequence[str | Column],
                 fraction: float = 0.1, confidence: float = 0.95, seed: int = 0,
                 extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Estimates of count, sum and mean with normal-approximation bounds.

    One row: for each of count/sum/mean the estimate (``*_mean``), ``low``,
    ``high``, plus ``confidence``. The sample is a hash sample of ``fraction``
    of the rows, aggregated with conditional sums in one pass; ``extra_aggs``
    (e.g. exact values to compare with) are computed in the same pass.
    """
    z = _z(confidence)
    p = float(fraction)
    x = col(column).cast("double") if column is not None else F.lit(1.0)
    inside = unit_hash(*key, seed=seed) < F.lit(p)
    xs = F.when(inside, x)
    a = df.agg(F.count(xs).alias("n"), F.sum(xs).alias("sx"), F.sum(xs * xs).alias("sxx"),
               F.avg(xs).alias("m"), F.stddev_samp(xs).alias("sd"), *extra_aggs)
    n, sx, sxx = F.col("n").cast("double"), F.coalesce(F.col("sx"), F.lit(0.0)), F.coalesce(F.col("sxx"), F.lit(0.0))
    # Horvitz–Thompson estimates under Bernoulli(p) sampling
    cnt = n / F.lit(p)
    cnt_sd = F.sqrt(n * F.lit((1 - p) / (p * p)))
    tot = sx / F.lit(p)
    tot_sd = F.sqrt(sxx * F.lit((1 - p) / (p * p)))
    mean_sd = F.coalesce(F.col("sd") / F.sqrt(n), F.lit(0.0))
    zz = F.lit(z)
    extra = [c for c in a.columns if c not in ("n", "sx", "sxx", "m", "sd")]
    return a.select(
        F.lit(confidence).alias("confidence"),
        cnt.alias("count_mean"), (cnt - zz * cnt_sd).alias("count_low"), (cnt + zz * cnt_sd).alias("count_high"),
        tot.alias("sum_mean"), (tot - zz * tot_sd).alias("sum_low"), (tot + zz * tot_sd).alias("sum_high"),
        F.col("m").alias("mean_mean"), (F.col("m") - zz * mean_sd).alias("mean_low"),
        (F.col("m") + zz * mean_sd).alias("mean_high"), *extra,
    )


def approx_count_distinct(df: DataFrame, column: str | Column, relative_sd: float = 0.05,
                          out: str = "count_distinct") -> DataFrame:
    """HyperLogLog++ estimate. Its state has about (1.04 / relative_sd)² six-bit
    registers in every task: 0.3 KB at 0.05, 8 KB at 0.01, 800 KB at 0.001."""
    return df.agg(approx_count_distinct_col(column, relative_sd).alias(out))


def approx_count_distinct_col(column: str | Column, relative_sd: float = 0.05) -> Column:
    """The aggregate expression behind ``approx_count_distinct``; Spark refuses
    a ``relative_sd`` above 0.39, for which it has no register count."""
    if relative_sd <= 0:
        raise ValueError("relative_sd must be positive")
    return F.approx_count_distinct(col(column), rsd=relative_sd)


# --------------------------------------------------------------------------
# progressive estimates: read blocks until the answer is good enough
# --------------------------------------------------------------------------

def block_estimates(blocks: Sequence[tuple[int, float]], of: int, confidence: float = 0.95) -> dict[str, tuple[float, float, float]]:
    """(estimate, low, high) of count, sum and mean from (rows, sum) of some of ``of`` blocks.

    The blocks are a random set drawn without replacement; what blocks differ
    by gives the variance (none is left when all are read), with Student's
    quantile for the number of blocks. The mean is the ratio of the totals.
    """
    n = len(blocks)
    z = _z(confidence)
    nu = max(n - 1, 1)
    t = z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu**2)
    left = 1 - n / of

    def total(values: list[float]) -> tuple[float, float]:
        mean = sum(values) / n
        spread = sum((v - mean) ** 2 for v in values) / nu
        return of * mean, t * of * math.sqrt(left * spread / n) if n > 1 else math.inf * (left > 0) if left else 0.0

    rows, sums = [float(r) for r, _ in blocks], [s for _, s in blocks]
    (count, count_off), (whole, whole_off) = total(rows), total(sums)
    mean = whole / count if count else math.nan
    mean_off = total([s - mean * r for r, s in blocks])[1] / count if count else math.nan
    return {name: (x, x - off, x + off) for name, x, off in (("count", count, count_off), ("sum", whole, whole_off), ("mean", mean, mean_off))}


def progressive_estimate(df: DataFrame, column: str, target: str = "sum", rel_error: float = 0.05, confidence: float = 0.95,
                         seed: int = 0, first: int = 16, growth: float = 2.0, seconds: float | None = None,
                         clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """Estimates of count, sum and mean that read no more blocks than they need; one row.

    A block is a partition of ``df``, for a scan one split of its files. A
    seeded random order of the blocks is read in growing steps (``first``, then
    ``growth`` times as many in all): each step is a job over just these
    partitions, whose tasks return (rows, sum). It ends when the ``target``
    (count, sum or mean) has its bounds within ``rel_error`` of the estimate,
    when ``seconds`` are over, or when all blocks are read; then the answer is
    exact. Columns: confidence, blocks, blocks_read, and ``*_mean``, ``*_low``,
    ``*_high`` of each. Null values count as rows of value 0.

    The bounds rest on what the blocks read differ by: where a few blocks of
    very many hold most of the total, take a larger ``first``. For scans and
    what runs in their tasks; a shuffle below would be computed whole. The driver holds two numbers for each block read.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in batches:
            n += b.num_rows
            total += pc.sum(b.column(0)).as_py() or 0.0
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([total], pa.float64())})

    spark = df.sparkSession
    rows = df.select(col(column).cast("double").alias("x")).mapInArrow(part, "n long, s double").rdd
    order = list(range(rows.getNumPartitions()))
    random.Random(seed).shuffle(order)
    read, begin, step = [], clock(), first
    while True:
        ahead = order[len(read) : step]
        read += [tuple(r) for r in spark.sparkContext.runJob(rows, list, ahead)] if ahead else []
        if not read:
            break
        found = block_estimates(read, len(order), confidence)
        x, low, high = found[target]
        if len(read) == len(order) or len(read) > 1 and (high - low) / 2 <= rel_error * abs(x) or seconds is not None and clock() - begin >= seconds:
            break
        step = max(len(read) + 1, int(len(read) * growth))
    if not read:
        found = {name: (0.0, 0.0, 0.0) for name in ("count", "sum", "mean")}
    values = {f"{name}_{k}": v for name, three in found.items() for k, v in zip(("mean", "low", "high"), three, strict=True)}
    names = "confidence double, blocks long, blocks_read long, " + ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([(confidence, len(order), len(read), *values.values())], names)


# --------------------------------------------------------------------------
# distinct counts that can be kept: sketches stored now, merged later
# --------------------------------------------------------------------------

def distinct_sketches(df: DataFrame, column: str | Column, by: Sequence[str] = (), log2_size: int = 12, out: str = "sketch") -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of the distinct values, one row a group.

    A sketch is binary, of about 2 ** ``log2_size`` bytes at most, and can be
    stored with its batch; nulls don't count. The standard error is about
    1.04 / sqrt(2 ** log2_size): 1.6 % at 12.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(col(column), F.lit(int(log2_size))).alias(out))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = (), sketch: str = "sketch", out: str = "count_distinct") -> DataFrame:
    """(by, estimate) of the union of stored sketches: values in several of them count once."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(out))
