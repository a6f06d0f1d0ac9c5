"""Whole-dataset aggregation.

Built-in aggregates plan as partial HashAggregate per task + one final
aggregate over one row per task. User functions (``reduce_with``,
``aggregate_with``) fold each partition in Arrow batches and merge the
per-partition partials as a tree, so no task merges more than ``fan_in``.
"""

from __future__ import annotations

import copy
import functools
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.functions.exprs import col

#: Groups that each level of a tree merge leaves to the next.
FAN_IN = 256
_PARTIAL = pa.schema([("g", pa.int32()), ("p", pa.binary())])

_OPS = {
    "sum": F.sum, "min": F.min, "max": F.max, "product": F.product,
    "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor,
    "bool_and": F.bool_and, "bool_or": F.bool_or,
}


def _require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("no rows to reduce")


def reduce(df: DataFrame, column: str | Column, op: str = "sum", out: str = "value",
           strict: bool = False) -> DataFrame:
    """One row: ``op`` over the column. Empty input gives NULL (sum: 0);
    ``strict`` raises instead, as the RDD reduce does (reads one row)."""
    if strict:
        _require_rows(df)
    agg = _OPS[op](col(column))
    if op == "sum":
        agg = F.coalesce(agg, F.lit(0))
    return df.agg(agg.alias(out))


def _tree_group(fan_in: int) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(int(fan_in))).alias("__g")


def tree_reduce(df: DataFrame, column: str | Column, op: str = "sum", fan_in: int = FAN_IN,
                out: str = "value") -> DataFrame:
    """Two-level reduce: partitions are merged in ``fan_in`` groups first, so
    the last task merges ``fan_in`` rows however many partitions there are.

    ``reduce_with`` is the same for any Python function and any depth.
    """
    lvl1 = df.groupBy(_tree_group(fan_in)).agg(_OPS[op](col(column)).alias("__p"))
    return reduce(lvl1, "__p", op, out)


#: What a fold may start from: these operators change nothing with it ...
NEUTRAL = {"sum": 0, "product": 1, "bit_xor": 0}
#: ... and these may take any value, since applying it once or often is the same.
IDEMPOTENT = {"min": F.least, "max": F.greatest, "bit_or": lambda a, z: a.bitwiseOR(z),
              "bit_and": lambda a, z: a.bitwiseAND(z), "bool_and": lambda a, z: a & z, "bool_or": lambda a, z: a | z}


def folded(agg: Column, zero, op: str) -> Column:
    """``agg`` with the zero value: the one rule of ``fold`` and ``fold_by_key``."""
    if op in IDEMPOTENT:
        return F.coalesce(IDEMPOTENT[op](agg, F.lit(zero)), F.lit(zero))
    if op not in NEUTRAL:
        raise ValueError(f"{op} is not a fold")
    if zero != NEUTRAL[op]:
        raise ValueError(f"{zero!r} is not neutral for {op}: how often it counts would depend on partitions")
    return F.coalesce(agg, F.lit(zero))


def fold(df: DataFrame, column: str | Column, zero, op: str = "sum", out: str = "value") -> DataFrame:
    """Reduce from ``zero``; empty input gives ``zero``. Sum, product and xor
    take their neutral element, the others any value."""
    return df.agg(folded(_OPS[op](col(column)), zero, op).alias(out))


def aggregate_sum_count(df: DataFrame, column: str | Column) -> DataFrame:
    """(sum, count) in one pass; (0, 0) on empty input."""
    return df.agg(F.coalesce(F.sum(col(column)), F.lit(0)).alias("sum"), F.count(F.lit(1)).alias("count"))


def tree_aggregate_sum_count(df: DataFrame, column: str | Column, fan_in: int = FAN_IN) -> DataFrame:
    """As ``aggregate_sum_count``, partitions merged in ``fan_in`` groups first
    (``aggregate_with`` is the same for any functions and depth)."""
    lvl1 = df.groupBy(_tree_group(fan_in)).agg(F.sum(col(column)).alias("__s"), F.count(F.lit(1)).alias("__c"))
    return lvl1.agg(F.coalesce(F.sum("__s"), F.lit(0)).alias("sum"),
                    F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("count"))


def max_value(df: DataFrame, column: str | Column, out: str = "max", strict: bool = False) -> DataFrame:
    if strict:
        _require_rows(df)
    return df.agg(F.max(col(column)).alias(out))


def min_value(df: DataFrame, column: str | Column, out: str = "min", strict: bool = False) -> DataFrame:
    if strict:
        _require_rows(df)
    return df.agg(F.min(col(column)).alias(out))


def arg_max(df: DataFrame, value: str | Column, key: Column, out: str = "value") -> DataFrame:
    """The element (not the key) with the largest key; ties → largest element."""
    return df.agg(F.max(F.struct(key.alias("k"), col(value).alias("x")))["x"].alias(out))


def arg_min(df: DataFrame, value: str | Column, key: Column, out: str = "value") -> DataFrame:
    return df.agg(F.min(F.struct(key.alias("k"), col(value).alias("x")))["x"].alias(out))


def sum_value(df: DataFrame, column: str | Column, out: str = "sum") -> DataFrame:
    return df.agg(F.coalesce(F.sum(col(column)), F.lit(0)).alias(out))


def count_rows(df: DataFrame, out: str = "count") -> DataFrame:
    """Counts every row, NULL elements included."""
    return df.agg(F.count(F.lit(1)).alias(out))


def stats(df: DataFrame, column: str | Column) -> DataFrame:
    """count, mean, population and sample variance/stdev, min, max, sum — one pass."""
    x = col(column)
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.sum(x).alias("sum"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("stdev"),
        F.var_samp(x).alias("sample_variance"), F.stddev_samp(x).alias("sample_stdev"),
    )


def mean(df, column, out="mean"):
    return df.agg(F.avg(col(column)).alias(out))


def variance(df, column, out="variance"):
    return df.agg(F.var_pop(col(column)).alias(out))


def stdev(df, column, out="stdev"):
    return df.agg(F.stddev_pop(col(column)).alias(out))


def sample_stdev(df, column, out="sample_stdev"):
    return df.agg(F.stddev_samp(col(column)).alias(out))


def sample_variance(df, column, out="sample_variance"):
    return df.agg(F.var_samp(col(column)).alias(out))


def count_by_value(df: DataFrame, *columns: str, out: str = "count") -> DataFrame:
    """Frequency of each distinct element (the NULL element is a group)."""
    cols = list(columns) or df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def map_reduce_expr(df: DataFrame, expr: str, op: str = "sum", out_type: str | None = None,
                    out: str = "value") -> DataFrame:
    """Σ or Π of a numeric SQL expression over the rows, e.g. ``'x * x'``."""
    if op not in ("sum", "product"):
        raise ValueError("op must be 'sum' or 'product'")
    agg = _OPS[op](F.expr(expr))
    if out_type:
        agg = agg.cast(out_type)
    return df.agg(agg.alias(out))


# --------------------------------------------------------------------------
# user functions: per-partition fold in Arrow, then merge of the partials
# --------------------------------------------------------------------------

def _merge_partials(partials: DataFrame, merge: Callable, zero, has_zero: bool,
                    out_schema: str | None, depth: int, fan_in: int) -> DataFrame:
    """Merge (g, p) partials in ``depth`` levels; the last is one task with at
    most ``fan_in`` rows (with depth 1, one row per partition)."""
    shape = to_arrow_schema(_parse_datatype_string(out_schema or "p binary"))
    names = shape.names

    def merged(batches, start, seen):
        acc, g = start, 0
        for b in batches:
            for of, blob in zip(b.column("g").to_pylist(), b.column("p").to_pylist(), strict=True):
                x = pickle.loads(blob)
                acc, g = (merge(acc, x) if seen else x), of
                seen = True
        return acc, g, seen

    def level(below):
        def run(batches):
            acc, g, seen = merged(batches, None, False)
            if seen:
                yield pa.RecordBatch.from_pydict({"g": [g % below], "p": [pickle.dumps(acc)]}, schema=_PARTIAL)
        return run

    def final(batches):
        acc, _, seen = merged(batches, zero, has_zero)
        if seen:
            if out_schema is None:
                yield pa.RecordBatch.from_pydict({"p": [pickle.dumps(acc)]})
            else:
                vals = acc if len(names) > 1 else (acc,)
                yield pa.RecordBatch.from_pylist([dict(zip(names, vals))], schema=shape)

    for d in range(depth - 1, 0, -1):
        groups = fan_in**d
        partials = partials.repartitionById(groups, F.pmod("g", F.lit(groups))).mapInArrow(level(fan_in ** (d - 1)), "g int, p binary")
    return partials.repartition(1).mapInArrow(final, out_schema or "p binary")


def reduce_with(df: DataFrame, column: str, fn: Callable, out_schema: str | None = None,
                depth: int = 2, fan_in: int = FAN_IN) -> DataFrame:
    """Reduce with any commutative, associative Python function.

    Partitions are reduced in their tasks, then merged as a tree of ``depth``
    levels. One row: typed per ``out_schema`` (e.g. ``'value long'``) or the
    pickled result in ``p`` (see ``unpickle``); no row for empty input.
    """
    def part(batches):
        acc, seen = None, False
        for b in batches:
            vals = b.column(column).to_pylist()
            if vals:
                r = functools.reduce(fn, vals)
                acc = fn(acc, r) if seen else r
                seen = True
        if seen:
            yield _partial(acc)

    return _merge_partials(df.select(column).mapInArrow(part, "g int, p binary"), fn, None, False, out_schema, depth, fan_in)


def _partial(acc) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"g": [TaskContext.get().partitionId()], "p": [pickle.dumps(acc)]}, schema=_PARTIAL)


def aggregate_with(df: DataFrame, column: str, zero, seq_op: Callable, comb_op: Callable,
                   out_schema: str | None = None, depth: int = 2, fan_in: int = FAN_IN) -> DataFrame:
    """(zero, seqOp, combOp) aggregate with Python functions, merged as a tree
    of ``depth`` levels; one row.

    A tuple accumulator maps onto the fields of ``out_schema`` in order.
    """
    def part(batches):
        acc = copy.deepcopy(zero)
        for b in batches:
            for x in b.column(column).to_pylist():
                acc = seq_op(acc, x)
        yield _partial(acc)

    return _merge_partials(df.select(column).mapInArrow(part, "g int, p binary"), comb_op, zero, True, out_schema, depth, fan_in)


def unpickle(df: DataFrame):
    """Driver value of a pickled ``reduce_with`` / ``aggregate_with`` frame."""
    rows = df.collect()
    return pickle.loads(rows[0]["p"]) if rows else None
