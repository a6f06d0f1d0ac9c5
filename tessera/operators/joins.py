"""Equi-joins and co-grouping. All keys are null-safe: NULL
matches NULL, as Python key equality does.

Catalyst picks the strategy (broadcast hash when a side is small by
statistics, otherwise sort-merge; AQE splits skewed partitions of inner joins
at run time, ``join`` itself splits the hot keys of outer joins). A null-safe key is planned as ``coalesce(k, default), isnull(k)``,
so it still hash/sort-merges.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.keyed import chunked_groups

_R = "__r_"


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


#: Rows of one key on one side, from which on an outer join splits the key, and
#: the least share of the side's rows that such a key must hold: no more than
#: 1 / share keys of a side can be hot, so the set of them may be broadcast.
HOT_ROWS, HOT_SHARE = 1_000_000, 0.001
_OUTER = {"left_outer": "left", "right_outer": "right", "full_outer": "full", "outer": "full"}


def join(a: DataFrame, b: DataFrame, on: str | Sequence[str], how: str = "inner",
         right_on: str | Sequence[str] | None = None, null_safe: bool | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Null-safe equi-join; the key appears once (from whichever side has it).

    how: inner | left | right | full | left_anti | left_semi.
    Non-key columns of ``b`` that clash with ``a`` get a ``_2`` suffix.
    ``null_safe`` (default: unless every key column is declared non-null)
    makes NULL match NULL; plain equality lets frames that are already
    hash-partitioned on the key join without another shuffle.

    Adaptive execution splits a hot key of an inner join on either side, of an
    outer join only on the side that is kept, of a full join on none. So an
    outer join measures its keys first (a pre-aggregated count of the keys of
    both sides) and treats those with more than ``hot_rows`` rows and more than
    ``HOT_SHARE`` of all rows on a side apart (``_split_join``).
    ``hot_rows=None`` leaves that out.
    """
    lk = _as_list(on)
    rk = _as_list(right_on) if right_on is not None else lk
    how = _OUTER.get(how, how)
    if null_safe is None:
        null_safe = any(a.schema[x].nullable for x in lk) or any(b.schema[y].nullable for y in rk)
    b_other = [c for c in b.columns if c not in rk]
    rb = b.select(*[F.col(c).alias(_R + c) for c in rk],
                  *[F.col(c).alias(c + "_2" if c in a.columns else c) for c in b_other])
    rk = [_R + c for c in rk]
    if how in _OUTER.values() and hot_rows:
        return _split_join(a, rb, lk, rk, how, null_safe, int(hot_rows))
    return _equi_join(a, rb, lk, rk, how, null_safe)


def _equi_join(a: DataFrame, rb: DataFrame, lk: list[str], rk: list[str], how: str, null_safe: bool, also: Sequence[str] = ()) -> DataFrame:
    """``a`` joined with ``rb``, whose names don't clash, on the keys and on equal columns ``also``."""
    cond = None
    for x, y in zip(lk, rk, strict=True):
        c = a[x].eqNullSafe(rb[y]) if null_safe else (a[x] == rb[y])
        cond = c if cond is None else cond & c
    for c in also:
        cond = cond & (a[c] == rb[_R + c])
    j = a.join(rb, cond, how)
    if how in ("left_anti", "left_semi", "anti", "semi"):
        return j
    key_cols = []
    for x, y in zip(lk, rk, strict=True):
        if how == "right":
            key_cols.append(F.col(y).alias(x))
        elif how == "full":
            key_cols.append(F.coalesce(a[x], F.col(y)).alias(x))
        else:
            key_cols.append(a[x])
    gone = {*lk, *rk, *also, *(_R + c for c in also)}
    return j.select(*key_cols, *[a[c] for c in a.columns if c not in gone], *[F.col(c) for c in rb.columns if c not in gone])


def _split_join(a: DataFrame, rb: DataFrame, lk: list[str], rk: list[str], how: str, null_safe: bool, hot_rows: int) -> DataFrame:
    """Outer join that spreads the rows of hot keys; lazy, one plan for all keys.

    * A key that isn't hot goes through the plain join.
    * A hot key that both sides hold has no row without a partner, so its rows
      meet in an inner join: ``a``'s are dealt to ceil(rows / hot_rows) cells
      and copied to as many as ``rb`` has, and the other way round, so that
      every pair meets in one cell and no cell holds more than ``hot_rows``
      rows of a side.
    * A hot key that one side holds needs no join: its rows, where their side
      is kept, get nulls for the other side. So do NULL keys that match nothing.

    Rows are dealt by ``monotonically_increasing_id``, which recomputing a
    lost partition gives again.
    """
    names, n = [f"__k{i}" for i in range(len(lk))], F.col
    sizes = [f.groupBy(*(n(k).alias(x) for k, x in zip(ks, names, strict=True))).agg(F.count(F.lit(1)).alias("rows")) for f, ks in ((a, lk), (rb, rk))]
    every = sizes[0].select(*names, n("rows").alias("__na"), F.lit(0).cast("long").alias("__nb"))
    every = every.unionByName(sizes[1].select(*names, F.lit(0).cast("long").alias("__na"), n("rows").alias("__nb")))
    every = every.groupBy(*names).agg(F.max("__na").alias("__na"), F.max("__nb").alias("__nb"))
    least = [F.greatest(F.lit(hot_rows), size.agg(F.sum("rows") * HOT_SHARE).scalar()) for size in sizes]
    hot = every.where((n("__na") > least[0]) | (n("__nb") > least[1]))
    meet = (n("__na") > 0) & (n("__nb") > 0)
    if not null_safe:
        meet = meet & functools.reduce(Column.__and__, (n(x).isNotNull() for x in names))
    cells = [F.greatest(F.ceil(n(c) / F.lit(hot_rows)), F.lit(1)).cast("int") for c in ("__na", "__nb")]
    hot = hot.select(*names, meet.alias("__meet"), cells[0].alias("__ca"), cells[1].alias("__cb"))

    def marked(f: DataFrame, ks: list[str]) -> DataFrame:
        same = functools.reduce(Column.__and__, (f[k].eqNullSafe(hot[x]) for k, x in zip(ks, names, strict=True)))
        return f.join(F.broadcast(hot), same, "left").drop(*names)  # at most 2 / HOT_SHARE rows

    ma, mb = marked(a.withColumn("__id", F.monotonically_increasing_id()), lk), marked(rb.withColumn(_R + "__id", F.monotonically_increasing_id()), rk)
    helpers = ["__id", _R + "__id", "__meet", "__ca", "__cb"]
    cold = _equi_join(*(f.where(n("__meet").isNull()).drop(*helpers) for f in (ma, mb)), lk, rk, how, null_safe)

    def dealt(f: DataFrame, own: str, other: str, mark: str) -> DataFrame:
        f = f.where("__meet").withColumn(f"{mark}{own}_cell", F.pmod(n(f"{mark}__id"), n(own)).cast("int"))
        return f.withColumn(f"{mark}{other}_cell", F.explode(F.sequence(F.lit(0), n(other) - 1))).drop(*helpers)

    met = _equi_join(dealt(ma, "__ca", "__cb", ""), dealt(mb, "__cb", "__ca", _R), lk, rk, "inner", null_safe, ("__ca_cell", "__cb_cell"))
    out = cold.unionByName(met.select(*cold.columns))
    kinds = {f.name: f.dataType for f in cold.schema}
    if how in ("left", "full"):
        alone = ma.where(~n("__meet"))
        out = out.unionByName(alone.select(*(alone[c] if c in a.columns else F.lit(None).cast(kinds[c]).alias(c) for c in cold.columns)))
    if how in ("right", "full"):
        alone, as_left = mb.where(~n("__meet")), dict(zip(lk, rk, strict=True))
        out = out.unionByName(alone.select(*(
            alone[as_left[c]].alias(c) if c in as_left else alone[c] if c in rb.columns else F.lit(None).cast(kinds[c]).alias(c) for c in cold.columns)))
    return out


def subtract_by_key(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b``; duplicates of ``a`` kept.

    ``b`` is reduced to its distinct keys first (a partial aggregate), so a
    hot key on the right costs one row in the join.
    """
    keys = _as_list(on)
    return join(a, b.select(*keys).distinct(), keys, "left_anti")


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows (the operator itself is the product).

    Without a hint: Spark broadcasts a side that its statistics show to be
    small in bytes, otherwise it runs its partitioned product. Clashing names
    of ``b`` get a ``_2`` suffix.
    """
    rb = b.select(*[F.col(c).alias(c + "_2" if c in a.columns else c) for c in b.columns])
    return a.crossJoin(rb)


def cogroup(frames: Sequence[DataFrame], key: str = "k", value: str = "v", *, chunk_rows: int) -> DataFrame:
    """n-way co-group: (k, chunk, values_0, …, values_{n-1}).

    All inputs are tagged and unioned, then grouped **once** for any n. A side without rows for a key gives an empty array; NULL values
    are kept. A key with more than ``chunk_rows`` values on one side is split
    into several rows (``chunk`` 0, 1, …) of at most ``chunk_rows`` values per
    side, so no output row or task holds an unbounded group. Keys below the
    limit have exactly one row with ``chunk`` 0.
    """
    tagged = None
    for i, f in enumerate(frames):
        t = f.select(F.col(key).alias("k"), F.lit(i).alias("__tag"), F.col(value).alias("v"))
        tagged = t if tagged is None else tagged.unionByName(t)
    out = chunked_groups(tagged, ["k"], "v", chunk_rows, side="__tag", sides=len(frames), sort_values=False)
    return out.withColumnRenamed("k", key)
