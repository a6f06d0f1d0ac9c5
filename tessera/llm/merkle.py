"""Merkle manifest of a table by nested-interval labels.

Every record has a digest and a rank inside its group (a source, say). The
group's tree is built level by level: a node covers an interval of ranks, and
up to ``RUN`` = 16 consecutive nodes become one, whose digest is that of their
digests in a row. The roots of the groups are the records of one more tree.

Proofs come from the labels alone. Level by level from the top, a node is
joined with the node above whose interval holds its own; the bucket of the
join is (tree, first rank by the width of the level above), so that each node
meets one candidate. Its siblings are what is left of the parent's interval
without its own: the children before and those after it.

Texts never move: what is shuffled is a digest and some numbers for each
record, and for each parent its at most 16 children and the way to the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, stored
from tessera.operators.position import row_index

#: Children of a node.
RUN = 16


def record_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values in a row: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(digest: Column, steps: Column) -> Column:
    """Root that a digest and its siblings, level by level, give."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """Digests of all siblings up to the root in a row, left to right, level by level."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def _bucket(level: int) -> Column:
    """Number of the node of a level that covers the leaf with rank ``lo``."""
    return F.floor(F.col("lo") / F.lit(RUN**level)).cast("long")


def _levels(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Nodes of each level: tree, size (leaves of the tree), lo, hi, digest and, above the leaves, kids.

    A tree ends at the level whose width reaches its size, so small trees are
    lower than large ones.
    """
    levels = [leaves]
    while RUN ** (len(levels) - 1) < largest:
        k = len(levels)
        open_ = levels[-1].where(F.col("size") > RUN ** (k - 1))
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids")
        above = open_.groupBy("tree", _bucket(k).alias("bucket")).agg(F.first("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids)
        above = above.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256))
        levels.append(stored(above.drop("bucket"), "merkle-level"))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``steps`` to the root and what ``tops`` (tree, steps, more) holds for their tree."""
    carried = [c for c in tops.columns if c not in ("tree", "steps")]
    below = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        found = nodes.where(F.col("size") <= RUN**k).join(tops, "tree")
        if below is not None:
            up = below.select(
                F.col("tree").alias("up_tree"), _bucket(k + 1).alias("up_bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"),
                F.col("kids").alias("up_kids"), F.col("steps").alias("up_steps"), *carried,
            )
            inside = (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
            same = (F.col("tree") == F.col("up_tree")) & (_bucket(k + 1) == F.col("up_bucket")) & inside
            before = F.filter("up_kids", lambda x: x["hi"] <= F.col("lo"))
            after = F.filter("up_kids", lambda x: x["lo"] >= F.col("hi"))
            step = F.struct(F.array_join(before["digest"], "").alias("left"), F.array_join(after["digest"], "").alias("right"))
            inner = nodes.where(F.col("size") > RUN**k).join(up, same)
            inner = inner.withColumn("steps", F.concat(F.array(step), F.col("up_steps")))
            found = found.unionByName(inner.select(*found.columns))
        below = found
    return below


def manifest(records: DataFrame, group_col: str, order_by: Sequence[str], digest_col: str) -> DataFrame:
    """All columns of ``records`` with ``merkle_rank``, ``subroot``, ``root`` and ``steps``, one row for each row.

    ``digest_col`` holds a record's digest; a group's records are ranked by
    ``order_by`` and then the digest (nulls first). Groups are ordered by value,
    null first, text by its UTF-8 bytes. ``steps`` has for each level from the
    record to the root the digests of its siblings, ``left`` and ``right`` of
    it. A group of one record is its own subroot; of one group, the subroot is
    the root. Rows repeated with one digest are records of their own, each at
    its place; nulls may stand in any column but the digest; texts of any
    length count by their digest only; an empty table gives an empty result.
    Columns of ``records`` keep their names, whatever they are; only its own
    ``merkle_rank``, ``subroot``, ``root`` and ``steps`` are replaced.
    """
    named = [c for c in records.columns if c.lower() not in ("merkle_rank", "subroot", "root", "steps")]
    # The columns go on under other names, so that no name of the tree clashes.
    plain = stored(records.select(*(col(c).alias(f"c{i}") for i, c in enumerate(named))), "merkle-records")
    at = {c: f"c{i}" for i, c in enumerate(named)}
    group, digest = at[group_col], at[digest_col]
    ranked = stored(row_index(plain, [group, *(at[c] for c in order_by), digest], index_col="place"), "merkle-ranks")
    groups = ranked.groupBy(group).agg(F.min("place").alias("tree"), F.count(F.lit(1)).alias("size"))
    groups = stored(groups.withColumnRenamed(group, "group"), "merkle-groups")
    leaves = ranked.join(groups, F.col(group).eqNullSafe(F.col("group"))).withColumn("lo", F.col("place") - F.col("tree"))
    leaves = leaves.drop("group", "place").withColumn("hi", F.col("lo") + 1).withColumn("digest", F.col(digest))
    largest = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    levels = _levels(leaves, largest[0] or 0)

    roots = None
    for k, nodes in enumerate(levels):
        whole = nodes.where(F.col("size") <= RUN**k)
        if k:
            whole = whole.where(F.col("size") > RUN ** (k - 1))
        whole = whole.select("tree", "digest")
        roots = whole if roots is None else roots.unionByName(whole)
    # The place where a group begins orders the groups as their values do.
    subroots = row_index(roots.select("tree", F.col("digest").alias("subroot")), ["tree"], index_col="lo")
    subroots = stored(subroots.withColumnRenamed("tree", "group"), "merkle-subroots")
    crowns = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(largest[1]).cast("long").alias("size"), "lo", (F.col("lo") + 1).alias("hi"),
        F.col("subroot").alias("digest"), "group", "subroot",
    )
    crown_levels = _levels(crowns, largest[1])
    root = crown_levels[-1].select("tree", F.col("digest").alias("root"))
    top = root.withColumn("steps", F.array().cast("array<struct<left:string,right:string>>"))
    tops = _descend(crown_levels, top).select(F.col("group").alias("tree"), "steps", "subroot", "root")
    tops = stored(tops, "merkle-tops")
    out = _descend(levels, tops)
    return out.select(*(F.col(at[c]).alias(c) for c in named), F.col("lo").alias("merkle_rank"), "subroot", "root", "steps")
