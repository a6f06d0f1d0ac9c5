"""Exact ranked lexical search by a sparse ball tree.

A document's score for an item is an inner product: the item has a weight for
each of its terms, the document a value for each term it holds (see
``top_documents``). Documents are stored as sparse vectors over the items'
terms. Every block of documents is a subtree: it is split at far points into
balls of ever fewer documents, down to leaves. A ball's centroid c and radius
r bound what any of its documents scores, c.q + r |q|; both are taken in a
space where each term is stretched by its weight, so that a common term counts
little in the radius, and the bound is rounded up by more than the arithmetic
can lose.

The balls of a block are searched best first, all items at once: the ball
whose bound exceeds an item's worst kept score by most comes next, only with
the items that it can still serve; a ball that can serve none is left out
whole. At a leaf scores are computed exactly: they are integers below 2**53,
so products and sums in doubles lose nothing. A task keeps its best rows for
each item from block to block, and a window over all tasks' rows gives the
final ranks.

Items are the query set. They are taken in blocks of bounded size, each
broadcast; every block of items reads the documents once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import col, stored, utf8

#: Terms and items of one block of the query set, documents of one subtree and of one leaf.
BLOCK_TERMS, BLOCK_ITEMS, SUBTREE, LEAF = 4096, 4096, 2048, 48
#: Values of one dense subtree: its documents are fewer where the terms are many.
DENSE = 1 << 22
#: Bytes of text that are cut into words at once.
TEXT_BYTES = 4 << 20
#: Largest sum of a score that doubles hold exactly.
EXACT = 1 << 53

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all beyond ASCII; A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


@dataclass
class Block:
    """Some items of the query set. ``of``: item and term of each weight, ``vocabulary``: the terms' numbers."""

    items: list
    item: np.ndarray
    term: np.ndarray
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The query set in blocks, read one partition after the other."""
    ids, pairs, vocabulary = [], [], {}
    rows = items.select(col(item_col).alias("id"), F.encode(col(text_col), "utf-8").alias("text"))
    for r in rows.toLocalIterator():
        words = sorted(set(terms(r["text"])))
        if ids and (len(ids) >= BLOCK_ITEMS or len(vocabulary) + len(words) > BLOCK_TERMS):
            yield Block(ids, *np.array(pairs, np.int64).reshape(-1, 2).T, vocabulary)
            ids, pairs, vocabulary = [], [], {}
        pairs += [(len(ids), vocabulary.setdefault(w, len(vocabulary))) for w in words]
        ids.append(r["id"])
    if ids:
        yield Block(ids, *np.array(pairs, np.int64).reshape(-1, 2).T, vocabulary)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): length in terms of each document that has any, and its terms of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(col(id_col).alias("id"), F.encode(col(text_col), "utf-8").alias("text"))
    shape = ["id", "n", "terms", "counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, width = known.value, max(len(known.value), 1)

        def vector_rows(ids, lengths, found):
            holder = np.repeat(np.arange(len(found)), [len(f) for f in found])
            keys, counts = np.unique(holder * width + np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) * width).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
            some = pa.array([n > 0 for n in lengths])
            return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), *lists], shape).filter(some)

        for b in batches:
            lengths, found, size, begin = [], [], 0, 0
            for i, text in enumerate(b.column(1)):
                words = terms(text.as_py())
                here = [x for x in map(number.get, words) if x is not None]
                lengths.append(len(words))
                found.append(np.array(here, np.int64))
                size += len(words)
                if size > TEXT_BYTES // 8 or i == b.num_rows - 1:
                    yield vector_rows(b.column(0).slice(begin, i + 1 - begin), lengths, found)
                    lengths, found, size, begin = [], [], 0, i + 1

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


def _document_frequencies(found: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term: every task counts its own, one row a term comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    df = np.zeros(width, np.int64)
    for r in found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Balls:
    """Ball tree over the rows of a matrix; node 0 is the root, ``rows[i]`` the documents of leaf i (else None)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.centre, self.radius, self.kids, self.rows = [], [], [], []
        square = np.einsum("ij,ij->i", x, x)
        stack = [(np.arange(len(x)), -1)]
        while stack:
            rows, parent = stack.pop()
            here, part = len(self.rows), x[rows]
            centre = part.mean(axis=0)
            off = square[rows] - 2 * (part @ centre) + centre @ centre
            self.centre.append(centre)
            # Squares cancel when points are close: what that can lose is added.
            self.radius.append(math.sqrt(max(off.max(), 0) + 1e-9 * (square[rows].max() + 1)))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(here)
            split = self._split(part, square[rows], off) if len(rows) > leaf else None
            self.rows.append(rows if split is None else None)
            if split is not None:
                stack += [(rows[~split], here), (rows[split], here)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    @staticmethod
    def _split(part: np.ndarray, square: np.ndarray, off: np.ndarray) -> np.ndarray | None:
        """The half nearer to the point farthest from the centre than to the one farthest from that."""
        a = part[off.argmax()]
        to_a = square - 2 * (part @ a)
        b = part[to_a.argmax()]
        lean = to_a - (square - 2 * (part @ b))
        if lean.max() - lean.min() <= 1e-9 * (square.max() + 1):
            return None  # one point many times: a leaf of its own, whatever its size
        near = lean <= np.partition(lean, len(lean) // 2)[len(lean) // 2]
        return near if 0 < near.sum() < len(near) else lean < np.median(lean) if (lean < np.median(lean)).any() else lean < lean.max()


class Best:
    """The best rows of each item so far: as many as ``k`` by score, then by ascending id."""

    def __init__(self, items: int, k: int, id_type: pa.DataType):
        self.k, self.worst = k, np.ones(items)  # the least score that is still of use
        self.table = pa.table({"item": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], id_type)})
        self.fresh, self.rows = [], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.fresh.append(pa.table({"item": pa.array(item.astype(np.int32)), "score": pa.array(score.astype(np.int64)), "id": ids}))
        self.rows += len(item)
        if self.rows > max(4 * self.k * len(self.worst), 10_000):
            self.close()

    def close(self) -> pa.Table:
        if self.fresh:
            every = pa.concat_tables([self.table, *self.fresh])
            every = every.take(pc.sort_indices(every, [("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
            item = every["item"].to_numpy()
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            kth = rank == self.k - 1
            self.worst[item[kth]] = every["score"].to_numpy()[kth]
            self.table, self.fresh, self.rows = every.filter(pa.array(rank < self.k)), [], 0
        return self.table


def _search(x: np.ndarray, ids: pa.Array, weights: np.ndarray, holds: np.ndarray, best: Best) -> None:
    """Best rows of one subtree: documents ``x`` (dense values), items ``holds`` (terms x items, 0 or 1)."""
    stretched = x * weights[:, None].T
    tree = Balls(stretched)
    length = np.sqrt(holds.sum(axis=0))
    bounds = tree.centre @ holds + tree.radius[:, None] * length
    bounds += 1e-9 * (np.abs(bounds) + tree.centre.sum(axis=1)[:, None] + 1)
    queue = [(-math.inf, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        serves = np.flatnonzero(bounds[node] >= best.worst)
        if not len(serves):
            continue
        rows = tree.rows[node]
        if rows is None:
            for kid in tree.kids[node]:
                ahead = (bounds[kid] - best.worst).max()
                if ahead >= 0:
                    heapq.heappush(queue, (-ahead, kid))
            continue
        for begin in range(0, len(rows), SUBTREE):
            part = rows[begin : begin + SUBTREE]
            score = stretched[part] @ holds[:, serves]
            r, i = np.nonzero(score >= best.worst[serves])
            if len(r):
                best.add(serves[i], score[r, i], ids.take(pa.array(part[r])))
        if best.rows > best.k * len(best.worst):
            best.close()


def _top_of_block(found: DataFrame, block: Block, totals, k: int) -> DataFrame:
    """(item, id, score): each task's best rows for the items of a block."""
    spark, width, items = found.sparkSession, len(block.vocabulary), len(block.items)
    n_docs, n_terms = totals
    df = _document_frequencies(found, width)
    weights = np.array([weight(n_docs, int(d)) for d in df], np.float64)
    if weights.max(initial=0) * 1e6 * np.bincount(block.item, minlength=1).max(initial=1) >= EXACT:
        raise ValueError("an item has too many terms for exact scores in doubles")
    sent = spark.sparkContext.broadcast((block.item, block.term, weights))
    size = max(LEAF, min(SUBTREE, DENSE // max(width, 1)))
    id_type = to_arrow_schema(found.select("id").schema)[0].type

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, w = sent.value
        holds = np.zeros((width, items))
        holds[term, item] = 1
        best = Best(items, k, id_type)
        for b in batches:
            for begin in range(0, b.num_rows, size):
                part = b.slice(begin, size)
                n = part.column(1).to_numpy()
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                offsets = np.diff(part.column(2).offsets.to_numpy())
                m = np.repeat(50 + np.array([50 * int(a) * n_docs // n_terms for a in n], np.int64), offsets)
                x = np.zeros((len(n), width))
                x[np.repeat(np.arange(len(n)), offsets), part.column(2).flatten().to_numpy()] = 1_000_000_000 * tf // (1000 * tf + 20 * m)
                _search(x, part.column(0), w, holds, best)
        top = best.close().combine_chunks()
        for rows in top.to_batches():
            yield rows.select(["item", "id", "score"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(search, f"item int, id {kind}, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item, equal scores by ascending id.

    A term's weight is w = floor(1000 ln((2N + 2) / (2df + 1))) with N documents
    that have a term and df that have this one. A document of n terms, of L in
    all, holding a term tf times has the value (10**9 tf) div (1000 tf + 20 m)
    with m = 50 + (50 n N) div L. Only scores above 0 count.

    Null and empty texts have no term: such a document is in no result, such
    an item has none. Null ids come last among equal scores. Repeated rows
    are rows of their own. Items repeated with one id are searched each and
    ranked together. Texts of any
    length are counted whole, in memory in proportion to one. Other columns are
    ignored; empty tables give an empty result. Copies of a text are one ball
    of radius 0; however many they are, a task keeps k rows an item.
    """
    spark: SparkSession = docs.sparkSession
    id_type, item_type = (f.select(col(c)).schema[0].dataType for f, c in ((docs, id_col), (items, item_col)))
    totals, out = None, spark.createDataFrame([], f"item {item_type.simpleString()}, id {id_type.simpleString()}, score long")
    for block in item_blocks(items, item_col, item_text):
        if not block.vocabulary:
            continue
        found = stored(vectors(docs, block.vocabulary, id_col, text_col), "term-vectors")
        totals = totals or found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not totals[0]:
            break
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.items)), pa.int32()), "name": pa.array(block.items, to_arrow_schema(items.select(col(item_col)).schema)[0].type)}))
        top = _top_of_block(found, block, totals, k).join(names.withColumnRenamed("item", "no"), F.col("item") == F.col("no"))
        out = out.unionByName(top.select(F.col("name").alias("item"), "id", "score"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
