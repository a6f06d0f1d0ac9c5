"""Keyed aggregation.

Built-in aggregates get Spark's partial (map-side) + final aggregation, so a
hot key costs one row per task in the shuffle. Grouping that keeps every
value (group_by_key, group_by, cogroup) goes through ``chunked_groups``,
which never puts more than ``chunk_rows`` values of one key in one row.
Generic user functions (combine_by_key) combine some Arrow batches at once first;
Spark then groups the combiners in two steps, and Python merges those of a row.
"""

from __future__ import annotations

import copy
import functools
import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, MapType, StructType, VariantType, _parse_datatype_string

from tessera.functions.exprs import unit_hash
from tessera.operators.agg import folded

SLICE_SEED = 29


def chunked_groups(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int, side: str | None = None,
                   sides: int = 1, sort_values: bool = True, chunk_col: str = "chunk") -> DataFrame:
    """(keys, chunk, values_0, …): every value of a key, at most ``chunk_rows`` in one array.

    ``side`` names a column of numbers 0 to ``sides`` - 1; each has its own
    array. Lazy, one path for all keys, over a counted multiset:

    1. rows become (key, side, value, count), pre-aggregated in their tasks, so
       equal and null values cost one row however often they occur;
    2. of a value that occurs more than ``chunk_rows`` times, whole chunks go
       into rows of their own (numbers -1, -2, … inside the key); 1 to
       ``chunk_rows`` of it are left;
    3. a key with n values left on its largest side has ceil(n / chunk_rows)
       slices; a value's slice is taken from its hash, so that the slices of a
       hot key lie on many tasks;
    4. inside a slice, running counts over the sorted values give the borders:
       chunk = slice + slices * (running count // chunk_rows).

    Values are repeated only when a chunk is written, by the task that the
    chunk is dealt to. A key with up to ``chunk_rows`` values has the one chunk
    0. The result doesn't depend on the partitioning. Values are told apart as
    SQL groups them (NaN is one value, -0.0 is 0.0).
    """
    keys, by, r = list(keys), [side] if side else [], F.lit(int(chunk_rows))
    counted = df.groupBy(*keys, *by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    counted = counted.withColumn("__full", F.floor((F.col("__m") - 1) / r)).withColumn("__rest", F.col("__m") - F.col("__full") * r)

    def arrays(count: Column) -> list[Column]:
        """The runs (value, count) of each side; null from when() is dropped."""
        run = F.struct(F.col("__v").alias("v"), count.cast("int").alias("n"))
        return [F.collect_list(F.when(F.col(side) == i, run) if side else run).alias(f"values_{i}") for i in range(sides)]

    def written(runs: DataFrame) -> DataFrame:
        full = [F.flatten(F.transform(f"values_{i}", lambda x: F.array_repeat(x["v"], x["n"]))) for i in range(sides)]
        full = [F.array_sort(c) if sort_values else c for c in full]
        return runs.select(*keys, F.col("__chunk").cast("int").alias(chunk_col), *(c.alias(f"values_{i}") for i, c in enumerate(full)))

    left = counted.groupBy(*keys, *by).agg(F.sum("__rest").alias("__n")).groupBy(*keys).agg(F.max("__n").alias("__n"))
    left = left.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.ceil(F.col("__n") / r).cast("int").alias("__slices"))
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys))
    u = unit_hash(F.coalesce(F.col("__v").cast("string"), F.lit("")), seed=SLICE_SEED)
    slice_ = F.when(F.col("__slices") > 1, F.floor(u * F.col("__slices")).cast("int")).otherwise(F.lit(0))
    rows = counted.join(left, same).withColumn("__slice", slice_).repartition(*keys, "__slice")
    before = Window.partitionBy(*keys, "__slice", *by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    begin, rest = F.col("__begin"), F.col("__rest")
    rows = rows.withColumn("__begin", F.coalesce(F.sum("__rest").over(before), F.lit(0)))
    rows = rows.withColumn("__sub", F.explode(F.sequence(F.floor(begin / r), F.floor((begin + rest - 1) / r))))
    here = F.least(begin + rest, (F.col("__sub") + 1) * r) - F.greatest(begin, F.col("__sub") * r)
    small = rows.groupBy(*keys, "__slice", "__sub").agg(F.max("__slices").alias("__slices"), *arrays(here))
    small = small.withColumn("__chunk", F.col("__slice") + F.col("__slices") * F.col("__sub"))

    earlier = Window.partitionBy(*keys).orderBy(*by, "__v").rowsBetween(Window.unboundedPreceding, -1)
    large = counted.where(F.col("__full") > 0).withColumn("__done", F.coalesce(F.sum("__full").over(earlier), F.lit(0)))
    large = large.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)))
    large = large.withColumn("__chunk", -(F.col("__done") + F.col("__i") + 1))
    large = large.repartition(*keys, "__chunk").groupBy(*keys, "__chunk").agg(*arrays(r))
    return written(small).unionByName(written(large))


# --------------------------------------------------------------------------
# built-in keyed aggregates
# --------------------------------------------------------------------------

_OPS = {
    "sum": F.sum, "min": F.min, "max": F.max, "product": F.product,
    "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor,
    "count": F.count, "avg": F.avg, "bool_and": F.bool_and, "bool_or": F.bool_or,
}


def reduce_by_key(df: DataFrame, op: str = "sum", k: str | Sequence[str] = "k", v: str = "v",
                  out: str = "v") -> DataFrame:
    """(k, op over v); op is a commutative, associative built-in."""
    ks = [k] if isinstance(k, str) else list(k)
    return df.groupBy(*ks).agg(_OPS[op](v).alias(out))


def fold_by_key(df: DataFrame, zero, op: str = "sum", k: str = "k", v: str = "v", out: str = "v") -> DataFrame:
    """Reduce per key from ``zero``, by the rule of ``agg.fold``: sum, product
    and xor take their neutral element, the others any value."""
    return df.groupBy(k).agg(folded(_OPS[op](v), zero, op).alias(out))


def aggregate_by_key(df: DataFrame, k: str = "k", v: str = "v") -> DataFrame:
    """(k, sum, count) with built-in aggregates; ``aggregate_by_key_with`` takes any functions."""
    return df.groupBy(k).agg(F.sum(v).alias("sum"), F.count(F.lit(1)).alias("count"))


def aggregate_by_key_with(df: DataFrame, zero, seq_op: Callable, comb_op: Callable, k: str = "k", v: str = "v",
                          finish: Callable | None = None, out_type: str = "string") -> DataFrame:
    """(k, result) for any (zero, seqOp, combOp) of Python functions."""
    return combine_by_key(df, lambda x: seq_op(copy.deepcopy(zero), x), seq_op, comb_op, k, v, finish, out_type)


def fold_by_key_with(df: DataFrame, zero, fn: Callable, k: str = "k", v: str = "v", out_type: str = "string") -> DataFrame:
    """(k, result) of folding each key's values with a Python function from ``zero``."""
    return aggregate_by_key_with(df, zero, fn, fn, k, v, None, out_type)


def count_by_key(df: DataFrame, k: str | Sequence[str] = "k", out: str = "count") -> DataFrame:
    ks = [k] if isinstance(k, str) else list(k)
    return df.groupBy(*ks).agg(F.count(F.lit(1)).alias(out))


def last_value_by_key(df: DataFrame, order: str, k: str = "k", v: str = "v", out: str = "v") -> DataFrame:
    """Value of the last row per key in ``order`` (the dict-building rule:
    the last pair for a key wins). ``order`` must be unique."""
    return df.groupBy(k).agg(F.max_by(v, order).alias(out))


def group_by_key(df: DataFrame, k: str = "k", v: str = "v", *, chunk_rows: int, sort_values: bool = True) -> DataFrame:
    """(k, chunk, values): every value of the key, NULLs included.

    ``chunk_rows`` bounds the values of one row: what a task can hold. Values
    are sorted within each row when ``sort_values``; keys with more values
    have several rows (see ``chunked_groups``).
    """
    return chunked_groups(df, [k], v, chunk_rows, sort_values=sort_values).withColumnRenamed("values_0", "values")


def group_by(df: DataFrame, key_expr: Column | str, value: str | Column | None = None,
             key: str = "k", *, chunk_rows: int) -> DataFrame:
    """Group by a computed key; the values are the rows (or ``value``)."""
    e = key_expr if isinstance(key_expr, Column) else F.expr(key_expr)
    if value is None:
        value = F.struct(*[F.col(c) for c in df.columns])
    vcol = F.col(value) if isinstance(value, str) else value
    keyed = df.select(e.alias(key), vcol.alias("__v"))
    return group_by_key(keyed, key, "__v", chunk_rows=chunk_rows)


# --------------------------------------------------------------------------
# generic combineByKey with user functions: Spark groups, Python combines
# --------------------------------------------------------------------------

#: Keys that Arrow can't group by; inside a batch they are told apart by their JSON text.
_NESTED = (ArrayType, MapType, StructType, VariantType)
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Rows and bytes of Arrow batches that combine_by_key combines at once (at least a batch).
TOGETHER_ROWS, TOGETHER_BYTES = 1 << 18, 1 << 24


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined into larger ones of bounded size."""
    some, n_rows, n_bytes = [], 0, 0
    for b in batches:
        some.append(b)
        n_rows, n_bytes = n_rows + b.num_rows, n_bytes + b.nbytes
        if n_rows >= TOGETHER_ROWS or n_bytes >= TOGETHER_BYTES:
            yield pa.concat_batches(some)
            some, n_rows, n_bytes = [], 0, 0
    if n_rows:
        yield pa.concat_batches(some)


def combine_by_key(df: DataFrame, create: Callable, merge_value: Callable, merge_combiners: Callable,
                   k: str | Sequence[str] = "k", v: str = "v", finish: Callable | None = None,
                   out_type: str = "string", fan_in: int = 64) -> DataFrame:
    """(k, result) for arbitrary Python combiner functions.

    ``k`` is a column of any type that can be grouped (structs and arrays
    included) or several columns. NULL, NaN and -0.0 keys group as in SQL.

    Map side: the values of some Arrow batches (``TOGETHER_ROWS`` rows or
    ``TOGETHER_BYTES``) are combined key by key before any row moves, so a hot
    key costs one row for these. Then Spark groups the combiners, first those
    of the first, second, ... such round of ``fan_in`` map tasks, so that a hot
    key's lie on many tasks and a row holds ``fan_in`` of them at most, however
    long the tasks are; then one for each of these rows, all of a key. Python
    only merges the combiners of a row, one row's at a time.
    """
    names = [k] if isinstance(k, str) else list(k)
    keys, marks = [f"k{i}" for i in range(len(names))], [f"g{i}" for i in range(len(names))]
    rows = df.select(*(F.col(c).alias(x) for c, x in zip(names, keys, strict=True)), F.col(v).alias("v"))
    nested = [isinstance(rows.schema[x].dataType, _NESTED) for x in keys]
    rows = rows.select("*", *(F.to_json(F.struct(x), _JSON).alias(g) for x, g, n in zip(keys, marks, nested, strict=True) if n))
    by = [g if n else x for x, g, n in zip(keys, marks, nested, strict=True)]
    key_type = StructType([rows.schema[x] for x in keys])
    partial_type = StructType([*key_type.fields]).add("c", BinaryType())
    round_type = StructType([*partial_type.fields]).add("round", IntegerType())
    result_type = StructType([*key_type.fields]).add("v", _parse_datatype_string(out_type))
    value_type = to_arrow_schema(StructType([result_type["v"]])).field(0).type

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(_together(batches)):
            numbered = pa.table({**{c: b.column(c) for c in by}, "row": pa.array(range(b.num_rows), pa.int64())})
            values, firsts, combiners = b.column("v").to_pylist(), [], []
            for group in numbered.group_by(by, use_threads=False).aggregate([("row", "list")])["row_list"].to_pylist():
                acc = create(values[group[0]])
                for i in group[1:]:
                    acc = merge_value(acc, values[i])
                firsts.append(group[0])
                combiners.append(pickle.dumps(acc))
            at = pa.array(firsts, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(at) for x in keys), pa.array(combiners, pa.binary()), pa.array([n] * len(at), pa.int32())], round_type.names)

    def merged(done: Callable, shape: pa.DataType, out: str):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = (functools.reduce(merge_combiners, map(pickle.loads, c.as_py())) for c in b.column("c"))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keys), pa.array([done(x) for x in found], shape)], [*keys, out])

        return merge

    task = F.floor(F.spark_partition_id() / F.lit(int(fan_in)))
    parts = rows.mapInArrow(combined, round_type).withColumn("task", task)
    some = parts.groupBy(*keys, "task", "round").agg(F.collect_list("c").alias("c")).drop("task", "round")
    some = some.mapInArrow(merged(pickle.dumps, pa.binary(), "c"), partial_type)
    out = some.groupBy(*keys).agg(F.collect_list("c").alias("c")).mapInArrow(merged(finish or (lambda x: x), value_type, "v"), result_type)
    return out.toDF(*names, "v")
