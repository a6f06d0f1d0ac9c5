"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a seeded random order, epoch after
epoch. A copy's virtual finish time is the source's tokens up to and with it,
divided by the source's target. The copies of all sources, as narrow rows, are
range-sorted by finish time and end where the total budget is used up: at any
point of that order all sources are served evenly. Running sums are two-level
(totals of small ranges, then inside each range), so no source and no global
order ever sits in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, numbered, stored

#: Rows of a hash range, about: what one task sorts at once.
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of runs ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size, target), one row for each source.

    Sources in code point order, null last, take the weights in turn. The
    budget, ``share`` times all sizes, is dealt by weight; no source gets more
    than ``max_repeats`` times its size, the excess goes to the others by
    weight. That is a water level: sorted by cap / weight, the first source
    whose share of what is left stays below its cap fixes the level for all
    after it. The windows run over one row for each source.
    """
    by_name, every = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy()
    by_cap = Window.orderBy("ratio", "rank")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(dealt, (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = share * F.sum("source_size").over(every) - (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("level", left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    s = s.withColumn("water", first["level"])
    return s.select("source", "source_size", F.least(F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight"), "cap").alias("target"))


@dataclass
class Mix:
    """What ``plan_mix`` found.

    ``rows`` (id, source, size, no): the documents, numbered among equals;
    ``ends``: for each source the place in its queue where the mix ends;
    ``schedule`` (rank, finish, source, id, no, epoch, size): the copies taken,
    ranks gapless from 0 in the order of their finish times; ``repeats``: keys
    of rows that are not alone."""

    rows: DataFrame
    ends: DataFrame
    schedule: DataFrame
    repeats: DataFrame
    seed: int
    max_repeats: int

    def copies(self) -> Column:
        """Copies of a row that the mix takes (columns th, id, no, and those of ``ends``)."""
        n = F.lit(0)
        for epoch in range(self.max_repeats):
            h = _order(self.seed, F.lit(epoch))
            inside = (F.col("end_epoch") > epoch) | ((F.col("end_epoch") == epoch) & (h <= F.col("end_order")))
            n = n + F.when(inside, 1).otherwise(0)
        return n

    def decisions(self) -> DataFrame:
        """id, size, source, source_size, target, copies: one row for each document."""
        j = self.rows.alias("r").join(self.ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left")
        return j.select("id", "size", F.col("r.source").alias("source"), "source_size", "target", self.copies().alias("copies"))


def _order(seed: int, epoch: Column) -> Column:
    """Place of a copy in its source's queue; depends on nothing but the row and its number among equals."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("id"), F.col("th"), F.col("no").cast("long"))


def _same() -> Column:
    """Key of rows equal in id, text and source. Others that share it are numbered with them, which does no harm."""
    return F.xxhash64("id", F.col("id").isNull(), "th", "source", F.col("source").isNull())


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"), col(source_col).alias("source")]


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan the mix of all of ``docs``.

    The size of a document is its number of words. The order of a queue hashes
    id and text with the seed, so reruns agree whatever the partitions. Rows
    that repeat in id, text and source are numbered, and each number has a
    place of its own: a source of repeated rows meets its target like any
    other, and reruns take as many of them. Null sources are one source, the
    last. Null and empty texts have size 0: they are taken with their neighbours
    and use up nothing. A text of any length is one row of its size; the mix may
    miss a target by it. An empty table gives an empty mix. Other columns are
    ignored.
    """
    sizes = docs.select(*_narrow(docs, id_col, text_col, source_col), word_count(col(text_col)).alias("size"))
    sizes = stored(sizes.withColumns({"same": _same(), "part": F.spark_partition_id()}), "mix-sizes")
    sources = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats), "mix-targets")
    repeats = stored(sizes.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same", F.lit(True).alias("again")), "mix-repeats")
    names = ["id", "th", "source", "size", "no"]
    marked = sizes.join(repeats, "same", "left")
    alone = marked.where("again IS NULL").withColumn("no", F.lit(0).cast("long"))
    rows = stored(alone.select(names).unionByName(numbered(marked.where("again"), "same", "no").select(names)), "mix-rows")
    n_rows = rows.count()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS))

    epochs = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("source_size")).cast("int"), F.lit(1)) - 1)
    copies = (
        rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("s.target") > 0))
        .select("id", "th", "no", "size", "s.source", "source_size", "target", F.explode(epochs).alias("epoch"))
        .withColumn("place", _order(seed, F.col("epoch")))
        .withColumn("range", F.least(F.floor((F.col("place") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)))
    )
    key = ["no_source", "name", "epoch", "range"]  # a null source gets a name of its own
    copies = copies.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    queue = Window.partitionBy(*key[:3]).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = copies.groupBy(*key).agg(F.sum("size").alias("in_range")).withColumn("before", F.coalesce(F.sum("in_range").over(queue), F.lit(0)))
    inside = Window.partitionBy(*key).orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    served = copies.join(before.drop("in_range"), key).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    served = served.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    order = ["finish", "no_source", "name", "place", "id"]
    sorted_copies = stored(
        served.select("no_source", "name", "source", "epoch", "place", "id", "no", "size", "finish")
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "mix-finish",
    )

    # ``at`` is (range << 33) + place in the range; one row for each range is summed up.
    queued = sorted_copies.withColumn("range", F.shiftright("at", 33))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = queued.groupBy("range").agg(F.sum("size").alias("in_range"), F.count(F.lit(1)).alias("rows"))
    totals = stored(totals.withColumns({"before": F.coalesce(F.sum("in_range").over(so_far), F.lit(0)), "rows_before": F.coalesce(F.sum("rows").over(so_far), F.lit(0))}), "mix-ranges")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cut = totals.where(F.col("before") + F.col("in_range") > F.lit(float(budget))).orderBy("range").first()
    if cut is None:
        taken = queued
    else:
        upto = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        last = queued.where(F.col("range") == cut["range"]).withColumn("upto", upto + cut["before"])
        taken = queued.where(F.col("range") < cut["range"]).unionByName(last.where(F.col("upto") <= F.lit(float(budget))).drop("upto"))
    rank = F.col("rows_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    schedule = taken.join(totals, "range").select(rank.alias("rank"), "finish", "source", "id", "no", "epoch", "size")
    end = taken.groupBy("no_source", "name").agg(F.max(F.struct("epoch", "place")).alias("end"), F.first("source").alias("source"))
    ends = sources.alias("s").join(end.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    ends = ends.select("s.source", "source_size", "target", F.col("end.epoch").alias("end_epoch"), F.col("end.place").alias("end_order"))
    return Mix(rows, stored(ends, "mix-ends"), schedule, repeats, seed, max_repeats)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every column of ``docs``, a row for each copy taken.

    Texts stay where they are read: only the sources' ends (one row each) and
    the keys of repeated rows are joined to them. Of rows that repeat in id,
    text and source but differ elsewhere it is open which ones are taken. The
    order of the mix is ``plan_mix(...).schedule``. See ``plan_mix`` for nulls,
    ties and empty tables; input columns keep their names and values whatever
    they are called.
    """
    plan = plan_mix(docs, weights, share, max_repeats, seed, id_col, text_col, source_col)
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = docs.select(row.alias("row"), *_narrow(docs, id_col, text_col, source_col)).withColumn("part", F.spark_partition_id())
    names = ["row", "id", "th", "source", "no"]
    if plan.repeats.isEmpty():
        keyed = keyed.withColumn("no", F.lit(0))
    else:
        marked = keyed.withColumn("same", _same()).join(plan.repeats, "same", "left")
        again = stored(marked.where("again"), "mix-repeated")
        keyed = marked.where("again IS NULL").withColumn("no", F.lit(0).cast("long")).select(names)
        keyed = keyed.unionByName(numbered(again, "same", "no").select(names))
    j = keyed.alias("r").join(plan.ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")))
    out = j.select("row", plan.copies().alias("copies")).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
