"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has next to no Jaccard similarity with it.
So items are partitioned by size, and for each size class a document is seen
as overlapping windows of twice the class's largest size: an item of q
shingles that a document holds in one piece lies within one window of at most
4 q, where its similarity is at least 0.17. One equal minhash of 64 makes a
candidate (missed with 0.83^64 = 5e-6); items spread over a document meet
several windows and are as likely found. Minima are computed once, over base
blocks that all windows are made of. Items of up to ``TINY`` shingles, for
which minhashes say little, are candidates wherever one of their shingles is.
A candidate is verified by exact containment of the item's shingles in the
whole document.

Items are a query set: they go through all documents in blocks of bounded
size, each broadcast in turn. Documents are neither shuffled nor collected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import shingles as S
from tessera.llm.common import col, filter_batches, stored, utf8

FUNCTIONS = 64
TINY = 8
#: Bytes of item texts that are searched in one pass over the documents, about.
ITEM_BLOCK_BYTES = 4 << 20
_SEED = 20240611
_LOW = np.uint64(0xFFFF)


@dataclass
class ItemIndex:
    """One block of items: shingle sets, and minhashes by size class."""

    percent: int
    ids: list = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    by_width: dict[int, dict[int, list[int]]] = field(default_factory=dict)
    tiny: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    classes: dict[int, dict[tuple[int, int], list[int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]], percent: int) -> ItemIndex:
        """Items without words are left out: nothing contains them."""
        index, family = cls(percent), S.families(FUNCTIONS, _SEED)
        for item_id, text in items:
            words = S.words(text)[2] if text else np.empty(0, np.uint64)
            if not len(words):
                continue
            i = len(index.ids)
            index.ids.append(item_id)
            width = min(len(words), S.WIDTH)
            shingles = S.distinct(S.runs(words, width))
            index.sets.append(shingles)
            if width < S.WIDTH:  # a short item is a single shingle of its own width
                index.by_width.setdefault(width, defaultdict(list))[int(shingles[0])].append(i)
                continue
            if len(shingles) <= TINY:
                for h in shingles:
                    index.tiny[int(h)].append(i)
                continue
            keys = index.classes.setdefault(int(len(shingles)).bit_length(), defaultdict(list))
            for f, m in enumerate(S.minima(shingles, np.array([0, len(shingles)]), family)[0]):
                keys[(f, int(m))].append(i)
        return index


class Searcher:
    """Finds the items of one block in documents."""

    def __init__(self, index: ItemIndex):
        self.index, self.family = index, S.families(FUNCTIONS, _SEED)
        self.base = min((1 << c for c in index.classes), default=2 * TINY)
        self.tiny = np.zeros(1 << 16, bool)
        for h in index.tiny:
            self.tiny[h & 0xFFFF] = True
        self.marks = {}
        for c, keys in index.classes.items():
            marks = np.zeros((FUNCTIONS, 1 << 16), bool)
            for f, m in keys:
                marks[f, m & 0xFFFF] = True
            self.marks[c] = marks

    def _candidates(self, shingles: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minhash in some window."""
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths > 0)
        if not len(full) or not self.marks:
            return set()
        n_blocks = -(-lengths[full] // self.base)
        of = np.repeat(np.arange(len(full)), n_blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        starts = offsets[full][of] + nth * self.base
        minima = S.minima(shingles, np.r_[starts, len(shingles)], self.family)
        last = (np.cumsum(n_blocks) - 1)[of]  # last base block of the same text
        found = set()
        for c, marks in self.marks.items():
            half = (1 << c) // self.base  # a window has 2 * half base blocks and starts every half
            window = minima.copy()
            step = 1
            while step < 2 * half:  # window minima by doubling, never past the text's end
                reach = np.minimum(np.arange(len(of)) + step, last)
                np.minimum(window, window[reach], out=window)
                step *= 2
            at = np.flatnonzero(nth % half == 0)
            keys = self.index.classes[c]
            for f in range(FUNCTIONS):
                m = window[at, f]
                for k in np.flatnonzero(marks[f][(m & _LOW).astype(np.int64)]):
                    for i in keys.get((f, int(m[k])), ()):
                        found.add((int(full[of[at[k]]]), i))
        return found

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every contained item."""
        out = []
        for first, _, words, offsets in S.blocks(texts):
            shingles, at = S.shingles(words, offsets)
            wanted = defaultdict(list)
            pairs = self._candidates(shingles, at)
            if self.index.tiny:
                place = np.flatnonzero(self.tiny[(shingles & _LOW).astype(np.int64)])
                of = np.searchsorted(at, place, side="right") - 1
                pairs.update((int(t), i) for t, h in zip(of, shingles[place], strict=True) for i in self.index.tiny.get(int(h), ()))
            for t, i in pairs:
                wanted[t].append(i)
            for t, items in sorted(wanted.items()):
                have = S.distinct(shingles[at[t] : at[t + 1]])
                for i in sorted(items):
                    q = self.index.sets[i]
                    place = np.minimum(np.searchsorted(have, q), len(have) - 1)
                    shared = int(np.count_nonzero(have[place] == q))
                    if 100 * shared >= self.index.percent * len(q):
                        out.append((first + t, i, shared))
            for width, keys in self.index.by_width.items():
                known = np.sort(np.fromiter(keys, np.uint64, len(keys)))
                for t in range(len(offsets) - 1):
                    r = S.runs(words[offsets[t] : offsets[t + 1]], width)
                    place = np.minimum(np.searchsorted(known, r), len(known) - 1)
                    out += [(first + t, i, 1) for h in S.distinct(r[known[place] == r]) for i in keys[int(h)]]
        return out


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, percent: int, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of all items, block by block; only one block is on the driver at a time."""
    items = stored(benchmark.select(col(item_col).alias("id"), F.encode(col(text_col), "utf-8").alias("text")), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield ItemIndex.of([(r["id"], None if r["text"] is None else bytes(r["text"])) for r in own], percent)


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_shingles, shared, containment): every item that a document contains.

    An item is contained when at least ``percent`` of its distinct five-word
    shingles are among the document's. An item of fewer words is one shingle as
    a whole and must occur in one piece. Ids are of any type. Null and empty texts contain nothing,
    null and empty items are in nothing. Repeated rows of either table give a
    row each; ids may be null. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(col(id_col).alias("id"), F.encode(col(text_col), "utf-8").alias("text"))
    items = benchmark.select(col(item_col)).schema
    types, item_type = (rows.schema["id"].dataType.simpleString(), items[0].dataType.simpleString()), to_arrow_schema(items)[0].type
    schema = f"id {types[0]}, item_id {types[1]}, item_shingles long, shared long, containment double"
    out = None
    for index in _item_blocks(benchmark, item_col, item_text_col, percent, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for b in batches:
                hits = searcher.search(utf8(b.column(1)))
                sizes = [len(searcher.index.sets[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([t for t, _, _ in hits], pa.int64())),
                        pa.array([searcher.index.ids[i] for _, i, _ in hits], item_type),
                        pa.array(sizes, pa.int64()),
                        pa.array([s for _, _, s in hits], pa.int64()),
                        pa.array([s / n for (_, _, s), n in zip(hits, sizes, strict=True)], pa.float64()),
                    ],
                    ["id", "item_id", "item_shingles", "shared", "containment"],
                )

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that contain no item, with the same columns (see ``contained_items``)."""
    at = docs.columns.index(text_col)
    for index in _item_blocks(benchmark, item_col, item_text_col, percent, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[t for t, _, _ in searcher.search(utf8(b.column(at)))]] = False
                yield b.filter(pa.array(clean))

        docs = filter_batches(docs, keep)
    return docs
