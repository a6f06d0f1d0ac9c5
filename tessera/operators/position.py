"""Positional operators: dense index, unique id, zip.

A dense 0..N-1 index is computed without a one-task window:

1. the (sorted) rows are written once to the shared folder, each with
   ``monotonically_increasing_id()`` = (partition << 33) + its position inside
   the partition; both passes then read the same layout, whatever a caller
   keeps of it and whichever executors are lost;
2. rows are counted per partition — a table of at most #partitions rows;
3. a running sum over that small table gives each partition's offset;
4. the offsets are broadcast (their size is the partition count, a proven
   bound) and added to the in-partition position.

The write is the operator's own first pass; nothing stays persisted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir

_LOCAL_MASK = (1 << 33) - 1
_IN = "__tessera_in"
_POS = "__tessera_pos"
_PID = "__tessera_pid"
_N = "__tessera_n"
_OFF = "__tessera_off"


def _sort_col(c: str | Column, ascending: bool = True) -> Column:
    if isinstance(c, Column):
        return c
    return F.asc_nulls_first(c) if ascending else F.desc_nulls_last(c)


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with each row's place (``_POS``), written once and read back."""
    path = shared_dir(df.sparkSession, "layout")
    x = df.withColumn(_POS, F.monotonically_increasing_id())
    x.write.parquet(path)
    return df.sparkSession.read.schema(x.schema).parquet(path)


def _offsets(numbered: DataFrame) -> DataFrame:
    """Rows per partition → (partition, rows before it, rows): #partitions rows."""
    pid = F.shiftright(F.col(_POS), 33).cast("int")
    counts = numbered.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias(_N))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(_PID, F.coalesce(F.sum(_N).over(w), F.lit(0)).alias(_OFF), _N)


def _with_offsets(x: DataFrame, offsets: DataFrame, index_col: str) -> DataFrame:
    """``x`` has ``_POS``; add the dense index and drop helpers."""
    pid = F.shiftright(F.col(_POS), 33).cast("int")
    # one row per partition: broadcast is bounded by the partition count
    joined = x.join(F.broadcast(offsets), pid == F.col(_PID), "inner")
    idx = (F.col(_OFF) + F.col(_POS).bitwiseAND(F.lit(_LOCAL_MASK))).cast("long")
    keep = [c for c in x.columns if c not in (_POS, _IN)]
    return joined.select(idx.alias(index_col), *[x[c] for c in keep])


def zip_with_index(df: DataFrame, index_col: str = "idx", stable_input: bool = False) -> DataFrame:
    """0-based dense index in partition order (the input's own order).

    The input is written once, so that both passes see the same rows in the
    same places. ``stable_input=True`` leaves that out: only for a file scan
    and narrow operations on it, whose partitions are the same in any plan.
    """
    if not stable_input:
        x = _numbered(df)
        return _with_offsets(x, _offsets(x), index_col)
    x = df.withColumn(_POS, F.monotonically_increasing_id())
    return _with_offsets(x, _offsets(x), index_col)


def sorted_partitions(df: DataFrame, order_by: Sequence[str | Column], ascending: bool = True,
                      num_partitions: int | None = None) -> DataFrame:
    """Globally sorted frame; ties keep their input order.

    A range exchange of ``spark.sql.shuffle.partitions`` ranges, which
    adaptive execution merges where they are small. The input position is the
    last sort key, so a key that a third of the rows share is cut into many
    ranges. With ``num_partitions`` that many ranges are kept.
    """
    keys = [_sort_col(c, ascending) for c in order_by]
    x = df.withColumn(_IN, F.monotonically_increasing_id())
    keys.append(F.col(_IN).asc())
    if num_partitions:
        return x.repartitionByRange(int(num_partitions), *keys).sortWithinPartitions(*keys)
    return x.orderBy(*keys)


def _indexed(df: DataFrame, order_by: Sequence[str | Column], ascending: bool, index_col: str,
             num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    x = _numbered(sorted_partitions(df, order_by, ascending, num_partitions))
    offsets = _offsets(x)
    return _with_offsets(x, offsets, index_col), offsets


def row_index(df: DataFrame, order_by: Sequence[str | Column], ascending: bool = True,
              index_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Dense rank 0..N-1 of every row in the given order (ties: input order).

    Equals ``row_number() over (order by ...) - 1`` but runs on all tasks: one
    sort, whose ranges are written once, then a map over them.
    """
    return _indexed(df, order_by, ascending, index_col, num_partitions)[0]


def zip_with_unique_id(df: DataFrame, id_col: str = "uid", stride: int = 1 << 20) -> DataFrame:
    """Unique id ``position * stride + partition``, without a job, a shuffle or a copy.

    ``stride`` is the most partitions there may be (more raise an error): it
    stands for the partition count, which adaptive plans know only when they
    run. Ids have gaps and stay the same while the partitions do; write the
    result where they must outlive a recomputation behind a shuffle.
    """
    at = F.monotonically_increasing_id()
    x = df.withColumn(_POS, at)
    part, pos = F.shiftright(F.col(_POS), 33), F.col(_POS).bitwiseAND(F.lit(_LOCAL_MASK))
    uid = F.when(part < stride, pos * F.lit(int(stride)) + part).otherwise(F.raise_error(F.lit(f"more than {stride} partitions")).cast("long"))
    return x.select(uid.cast("long").alias(id_col), *[x[c] for c in df.columns])


def zip_frames(a: DataFrame, b: DataFrame, a_order: Sequence[str | Column],
               b_order: Sequence[str | Column], check: bool = True) -> DataFrame:
    """Pair rows of two frames by position in the given orders.

    Both sides are indexed and joined on the index (a shuffle on a unique key:
    no skew). Sizes must match, as for the RDD zip; they are sums of the
    partition counts that the indexes need anyway.
    """
    ia, na = _indexed(a, a_order, True, "__zip_i")
    ib, nb = _indexed(b, b_order, True, "__zip_i")
    rb = ib.select([F.col("__zip_i")] + [F.col(c).alias(f"{c}_2" if c in a.columns else c) for c in b.columns])
    if check:
        sizes = [n.agg(F.sum(_N)).first()[0] or 0 for n in (na, nb)]
        if sizes[0] != sizes[1]:
            raise ValueError(f"can only zip frames of equal size ({sizes[0]} != {sizes[1]})")
    return ia.join(rb, "__zip_i", "inner").withColumnRenamed("__zip_i", "idx")
