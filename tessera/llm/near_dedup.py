"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct five-word shingles. Two groups of small hash
collections (two minhashes each) are computed; a table's key combines one
collection of the first group with one of the second. ``side`` collections on
each side thus give ``side ** 2`` tables for ``4 * side`` minhashes instead of
``4 * side ** 2``. Two sets of similarity s share a table unless they miss all
collections of one side: (1 - s^2)^side each, 5e-5 at s = 0.75 and side 12.

Steps, each a Spark job over all documents:

1. sets, minhashes and a 128-bit fingerprint of every set; equal sets are one
   class, represented by its first row;
2. collections that occur once are dropped (they can't make a table collide),
   the rest are combined to table keys, keys that occur once are dropped;
3. in every bucket all members are compared with the smallest one; pairs are
   confirmed on the full shingle sets; linked classes are joined to components;
4. buckets that still hold members of several components (near the threshold,
   or texts that merely share a passage) are searched to the end: open buckets
   that share members are one group, a group is dealt to blocks of at most
   about ``BLOCK_MEMBERS``, and every pair of blocks is one cell, in which each
   member is compared with all others of other components on the full sets;
5. components over all confirmed links.

No step emits the pairs of a group: a cell emits only links that join two
components, less than it has members. Its rows are a group's members times the
group's blocks, its work the square of the group.

Step 3 confirms a pair on full sets only if 25 of its 48 minhashes agree (36
are expected at 0.75, standard deviation 3). A pair that is passed over by it
stays open for step 4, which has no such filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.common import col, stored, utf8
from tessera.llm.components import components

SIDE = 12
#: Members of a block in step 4, and bytes of their sets.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 16 << 20
PER_COLLECTION = 2
AGREEING = 25
_SEED = 20240517


def _signatures(docs: DataFrame, id_col: str, text_col: str, side: int) -> DataFrame:
    """(row_no, id, th, n_shingles, set_hi, set_lo, first, second, sketch) of every row."""
    family = S.families(2 * side * PER_COLLECTION, _SEED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            n = np.zeros(len(texts), np.int64)
            prints = np.zeros((len(texts), 2), np.uint64)
            collections = np.zeros((len(texts), 2 * side), np.uint64)
            sketch = np.zeros((len(texts), len(family)), np.uint16)
            for first, last, words, offsets in S.blocks(texts):
                h, at = S.shingles(words, offsets)
                full = np.flatnonzero(np.diff(at) > 0)
                for i in full:
                    d = S.distinct(h[at[i] : at[i + 1]])
                    n[first + i] = len(d)
                    prints[first + i] = S.mix(d).sum(), S.mix(d ^ np.uint64(0x5555555555555555)).sum()
                if len(full):
                    m = S.minima(h, np.r_[at[full], at[-1]], family)
                    sketch[first + full] = (m & np.uint64(0xFFFF)).astype(np.uint16)
                    collections[first + full] = _combine(m[:, 0::2], m[:, 1::2])
            empty = n == 0
            lists = [None if e else c.astype(np.int64) for e, c in zip(empty, collections, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k) for k in ("row_no", "id", "th")),
                    pa.array(n),
                    pa.array(prints[:, 0].astype(np.int64)),
                    pa.array(prints[:, 1].astype(np.int64)),
                    pa.array([None if x is None else x[:side] for x in lists], pa.list_(pa.int64())),
                    pa.array([None if x is None else x[side:] for x in lists], pa.list_(pa.int64())),
                    pa.array([None if e else s.tobytes() for e, s in zip(empty, sketch, strict=True)], pa.binary()),
                ],
                ["row_no", "id", "th", "n_shingles", "set_hi", "set_lo", "first", "second", "sketch"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        col(id_col).alias("id"),
        F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"),
        F.encode(col(text_col), "utf-8").alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        sign,
        f"row_no long, id {id_type}, th long, n_shingles long, set_hi long, set_lo long, first array<long>, second array<long>, sketch binary",
    )


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return S.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _shared_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key occurs at least twice.

    The count is pre-aggregated and joined back: both sides of the join are
    shuffles, so a key that holds a large share of the rows is split there.
    """
    live = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*key)
    return rows.join(live, key)


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, rep): buckets of at least two classes."""
    one = lambda side, c: reps.select("rep", F.lit(side).alias("side"), F.posexplode(c).alias("i", "c"))
    shared = _shared_keys(one(0, "first").union(one(1, "second")), ["side", "i", "c"])
    part = lambda side: F.collect_list(F.when(F.col("side") == side, F.xxhash64("i", "c")))
    both = shared.groupBy("rep").agg(part(0).alias("a"), part(1).alias("b"))
    tables = both.select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b"))
    return _shared_keys(tables.select("rep", F.xxhash64("a", "b").alias("key")), ["key"])


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(rep, size, shingles): sorted distinct shingles, eight bytes each, of the wanted classes.

    ``wanted`` has (rep, th): any text with that hash and set fingerprint serves.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, words, offsets in S.blocks(utf8(b.column("text"))):
                h, at = S.shingles(words, offsets)
                out += [S.distinct(h[at[i] : at[i + 1]]).tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(out, pa.binary())], ["rep", "shingles"])

    texts = docs.select(F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"), F.encode(col(text_col), "utf-8").alias("text"))
    found = texts.join(wanted, "th").select("rep", "text")
    return found.mapInArrow(build, "rep long, shingles binary").dropDuplicates(["rep"])


def _plausible(pairs: DataFrame, reps: DataFrame, agreeing: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree often enough and whose sizes allow the similarity."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("sketch_a").to_pylist()), np.uint16).reshape(b.num_rows, -1)
                y = np.frombuffer(b"".join(b.column("sketch_b").to_pylist()), np.uint16).reshape(b.num_rows, -1)
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agreeing))

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(agree, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= 75 * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                links.append(100 * common >= 75 * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    side = lambda n, s: sets.select(F.col("rep").alias(n), F.col("shingles").alias(s))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
    return joined.mapInArrow(compare, "a long, b long")


def _open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, component) of the buckets whose members are in several components."""
    rows = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spans = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return rows.join(spans.where("lo <> hi").select("key"), "key")


def _cells(open_rows: DataFrame, sets: DataFrame, block_members: int) -> DataFrame:
    """(group, i, j, block, rep, component, shingles): members of open groups, once for each pair of blocks."""
    first = open_rows.groupBy("key").agg(F.min("rep").alias("a"))
    edges = open_rows.join(first, "key").select("a", F.col("rep").alias("b")).distinct()
    groups = components(edges).toDF("rep", "group")
    sized = sets.select("rep", F.octet_length("shingles").cast("long").alias("bytes"))
    members = stored(open_rows.select("rep", "component").distinct().join(groups, "rep").join(sized, "rep"), "minhash-open-members")
    needed = F.greatest(F.count(F.lit(1)) / block_members, F.sum("bytes") / BLOCK_BYTES)
    dealt = members.join(members.groupBy("group").agg(F.ceil(needed).alias("blocks")), "group").join(sets, "rep")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "shingles")


def _joining(rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between the members ``left`` and ``right`` that join two components each.

    A member's shingles are marked and counted in all sets of ``right`` at once.
    """
    links, label = [], label.copy()
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    known, of = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(of, np.cumsum(size)[:-1])
    ids, at = np.concatenate([of[y] for y in right]), np.r_[0, np.cumsum(size[right])[:-1]]
    mark = np.zeros(len(known), np.uint8)
    for x in left:
        if (label[right] == label[x]).all():
            continue
        mark[of[x]] = 1
        common = np.add.reduceat(mark[ids], at, dtype=np.int64)
        mark[of[x]] = 0
        for y in right[100 * common >= 75 * (size[x] + size[right] - common)]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                links.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
    return links


def _searched(cells: DataFrame) -> DataFrame:
    """(a, b): links that join the components of a cell, found on the full sets."""

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        links = []
        if len(left) and len(right):
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            links = _joining(table.column("rep").to_numpy(), table.column("component").to_numpy(), sets, left, right)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("group", "i", "j").applyInArrow(search, "a long, b long")


def near_dup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, agreeing: int = AGREEING) -> DataFrame:
    """(row_no, id, th, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents with 100 * intersection >= 75 * union of their shingle sets are
    linked; ``component_id`` is the smallest id that links reach. ``kept`` is
    true for one row of each component, the (first) one with that id. Null and
    empty texts and texts without words have no shingles and are linked with
    nothing. Null ids count as larger than all others; a component with null
    ids only has a null component_id. Repeated rows are members like others.
    ``row_no`` numbers the rows as they were read, ``th`` hashes the text.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(_signatures(docs, id_col, text_col, side), "minhash")
    classes = rows.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("row_no").alias("rep"))
    reps = stored(rows.join(classes.select(F.col("rep").alias("row_no")), "row_no").withColumnRenamed("row_no", "rep"), "minhash-classes")

    buckets = stored(_buckets(reps), "minhash-buckets")
    leaders = buckets.groupBy("key").agg(F.min("rep").alias("a"))
    stars = buckets.join(leaders, "key").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    stars = stored(_plausible(stars, reps, agreeing), "minhash-pairs")
    members = buckets.select("rep").distinct()
    sets = stored(_sets(docs, reps.join(members, "rep").select("rep", "th"), text_col), "minhash-sets")
    links = stored(_confirmed(stars, sets), "minhash-links")

    open_rows = stored(_open_rows(buckets, components(links)), "minhash-open")
    links = links.union(stored(_searched(_cells(open_rows, sets, BLOCK_MEMBERS)), "minhash-links"))

    of_class = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    grouped = stored(rows.where("n_shingles > 0").select("row_no", "id", "set_hi", "set_lo").join(of_class, ["set_hi", "set_lo"]), "minhash-members")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no"))
    keep = grouped.groupBy("component").agg(first.alias("keep"))
    result = grouped.select("row_no", "component").join(keep, "component").select("row_no", "keep")
    out = rows.select("row_no", "id", "th", "n_shingles").join(result, "row_no", "left")
    lone = F.col("keep").isNull()
    return out.select(
        "row_no", "id", "th", "n_shingles",
        F.when(lone, F.col("id")).otherwise(F.col("keep.id")).alias("component_id"),
        (lone | (F.col("row_no") == F.col("keep.row_no"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with the same columns (see ``near_dup_classes``).

    Of rows that repeat in id and text one stays if any does, whichever.
    """
    kept = near_dup_classes(docs, id_col, text_col).where("kept")
    keys = kept.groupBy("id", "th").agg(F.count(F.lit(1)).alias("copies"))
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"))
    k = keys.select(F.col("id").alias("kept_id"), F.col("th").alias("kept_th"), "copies")
    joined = packed.join(k, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")))
    nth = F.row_number().over(Window.partitionBy("kept_id", "kept_th").orderBy("kept_th"))
    return joined.withColumn("nth", nth).where("nth <= copies").select("row.*")
