"""Element-wise operators: map, flat_map, filter, pair helpers,
numeric expression map, external-command pipe, key lookup.

A "pair frame" is any frame with a key column ``k`` and a value column ``v``
(names are parameters). Functions are SQL expressions / Columns first; a
Python function is accepted only through Arrow-batched paths
(``map_with``, ``flat_map_with``, and ``tessera.operators.layout``).
"""

from __future__ import annotations

import shlex
import subprocess
import threading
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col

#: Output rows after which a table function hands over a batch.
FLUSH_ROWS = 10_000


def _as_cols(exprs) -> list[Column]:
    out = []
    for e in exprs:
        if isinstance(e, Column):
            out.append(e)
        elif isinstance(e, str) and e in ("*",):
            out.append(F.col("*"))
        elif isinstance(e, str):
            out.append(F.expr(e))
        else:
            raise TypeError(f"expected Column or SQL text, got {type(e)}")
    return out


def map_rows(df: DataFrame, *exprs: Column | str) -> DataFrame:
    """One output row per input row (``select``)."""
    return df.select(*_as_cols(exprs))


def flat_map(df: DataFrame, array_expr: Column | str, alias: str = "value",
             keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """0..n output rows per input row: explode an array expression."""
    arr = array_expr if isinstance(array_expr, Column) else F.expr(array_expr)
    gen = F.explode_outer(arr) if outer else F.explode(arr)
    return df.select(*[F.col(c) for c in keep], gen.alias(alias))


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate if isinstance(predicate, Column) else F.expr(predicate))


def keys(df: DataFrame, k: str = "k") -> DataFrame:
    return df.select(k)


def values(df: DataFrame, v: str = "v") -> DataFrame:
    return df.select(v)


def map_values(df: DataFrame, expr: Column | str, v: str = "v") -> DataFrame:
    """Change the value, keep the key (and therefore any key partitioning)."""
    e = expr if isinstance(expr, Column) else F.expr(expr)
    return df.withColumn(v, e)


def flat_map_values(df: DataFrame, array_expr: Column | str, k: str = "k", v: str = "v") -> DataFrame:
    arr = array_expr if isinstance(array_expr, Column) else F.expr(array_expr)
    return df.select(F.col(k), F.explode(arr).alias(v))


def key_by(df: DataFrame, expr: Column | str, k: str = "k") -> DataFrame:
    """Add a key computed from the row; the row itself becomes ``v`` columns."""
    e = expr if isinstance(expr, Column) else F.expr(expr)
    return df.select(e.alias(k), *[F.col(c) for c in df.columns])


def vector_map(df: DataFrame, column: str, sql_expr: str, var: str = "x", out: str = "y") -> DataFrame:
    """Numeric expression in ``var`` applied to a column, e.g. ``'x * 4'``.

    The column is bound to ``var`` by an inner projection; Catalyst collapses
    both projections into one codegen'd expression.
    """
    return df.select(F.col(column).alias(var)).select(F.expr(sql_expr).alias(out))


def map_with(df: DataFrame, fn, out_type: str, *columns: str, out: str = "value",
             keep: Sequence[str] = ()) -> DataFrame:
    """One output per row from a Python function of pandas Series (Arrow
    batches, ``pandas_udf``) — only for functions SQL cannot express."""
    from pyspark.sql.functions import pandas_udf

    udf = pandas_udf(fn, out_type)
    return df.select(*[F.col(c) for c in keep], udf(*[F.col(c) for c in columns]).alias(out))


def flat_map_with(df: DataFrame, fn, schema: str) -> DataFrame:
    """0..n output rows per input row from a Python generator ``fn(row_dict)``
    over Arrow batches (``mapInArrow``); output batches follow ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow_schema.names

    def batch_of(rows):
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=arrow_schema)

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                for o in fn(row):
                    out.append(o)
                    if len(out) >= FLUSH_ROWS:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    return df.mapInArrow(run, schema)


def lateral(df: DataFrame, fn, *columns: str) -> DataFrame:
    """Every row of ``df`` with the rows that a table function makes of its ``columns``.

    ``fn`` is a ``udtf`` (``useArrow=True`` sends rows in batches); Spark
    joins it laterally, so rows without any result are left out. Of
    Arrow-native functions Spark takes no lateral joins; these are for
    ``over_partitions``.
    """
    return df.lateralJoin(fn(*(F.col(c).outer() for c in columns)))


def over_partitions(df: DataFrame, fn, by: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The rows that a table function makes of each key's rows, in order.

    ``fn`` is a ``udtf`` or ``arrow_udtf`` with a table argument. Spark deals
    the rows by key, sorts and spills them; the function sees them as they
    stream by and keeps what it wants between batches. A key's rows are one
    task by definition of the operator: use it where order inside the key is
    the point, else ``keyed.combine_by_key``.
    """
    table = df.asTable().partitionBy(*by)
    return fn(table.orderBy(*order_by) if order_by else table)


def lookup(df: DataFrame, key, k: str = "k", v: str = "v") -> DataFrame:
    """Values of one key (NULL matches NULL).

    On a table bucketed by the key (``layout.write_bucketed``) only the key's
    bucket is read, inside it only the row groups whose range holds the key;
    on any other, the filter is pushed to the scan.
    """
    return df.where(F.col(k).eqNullSafe(F.lit(key))).select(v)


# --------------------------------------------------------------------------
# pipe: each partition's rows to a command's stdin, its stdout lines back
# --------------------------------------------------------------------------

def _pipe_partition(command: list[str], column: str, env: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proc = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE,
                                env=env, bufsize=1 << 16)
        err: list[BaseException] = []

        def feed():
            try:
                for b in batches:
                    for s in b.column(column).to_pylist():
                        proc.stdin.write(("" if s is None else str(s)).encode("utf-8") + b"\n")
            except BaseException as e:  # noqa: BLE001
                err.append(e)
            finally:
                proc.stdin.close()

        t = threading.Thread(target=feed, daemon=True)
        t.start()
        out: list[str] = []
        for line in proc.stdout:
            out.append(line.decode("utf-8").rstrip("\n"))
            if len(out) >= 8192:
                yield pa.RecordBatch.from_pydict({"value": out}, schema=pa.schema([("value", pa.string())]))
                out = []
        t.join()
        rc = proc.wait()
        if err:
            raise err[0]
        if rc != 0:
            raise RuntimeError(f"pipe command {command!r} exited with status {rc}")
        if out:
            yield pa.RecordBatch.from_pydict({"value": out}, schema=pa.schema([("value", pa.string())]))

    return run


def pipe(df: DataFrame, command: str | list[str], column: str = "value", env: dict | None = None) -> DataFrame:
    """Stream each partition through an external command (one line per row).

    NULL is written as an empty line. A non-zero exit status fails the task
    (and Spark retries it), instead of being ignored.
    """
    cmd = shlex.split(command) if isinstance(command, str) else list(command)
    src = df.select(F.col(column).cast("string").alias(column))
    return src.mapInArrow(_pipe_partition(cmd, column, env), "value string")


def project_keys(df: DataFrame, k: str | Column, v: str | Column) -> DataFrame:
    """Build a pair frame ``(k, v)`` from two expressions."""
    return df.select(col(k).alias("k"), col(v).alias("v"))
