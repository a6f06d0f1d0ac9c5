"""Substring de-duplication by sliding sentence spans.

A text is cut into sentences (after ``. ! ?`` or a full stop of Chinese,
Japanese or Hindi at a word's end, also before closing quotes and brackets, and
at line ends; a sentence of more than ``LONG`` words also after ``, ; :``). From
every sentence a span runs over at least three consecutive sentences and on
until it has 20 words. Besides, every run of ``RUN`` = 50 words is a span,
wherever it begins, so no repeated passage of 50 words or more is kept. Spans
are hashed to 128 bits over their lower-cased words and joined over the whole
table. Of a repeated span the first occurrence (smallest id, then place)
stays; all words that any other occurrence covers go.

Runs of 50 words are as many as words, so only those are made that can be
repeated. Of every 31 consecutive 20-word hashes the smallest is an anchor
(winnowing). A run of 50 words holds such a window whole, so equal runs hold
an equal anchor at the same place: runs without an anchor that occurs twice
in the table occur once.

Nor is a run a row of its own. Consecutive runs with the same smallest 20-word
hash are a block (16 runs on average), with its anchor. Equal runs lie at the
same place of blocks with an equal anchor. So equal blocks are compared as a
whole, and the runs are made only of one block of each kind (its first
occurrence), where blocks of other kinds have the same anchor.

Spans of sentences are many, so they are cut twice and never stored: once to
find the repeated hashes with their first occurrence (pre-aggregated in each
task), once to join them. Anchors, the texts that have repeated ones and their
blocks are stored until the runs are known. Texts are cut many at once, joined
to blocks of bounded size (``shingles.located``); no span reaches into another
text.
Rows that share an id and a text, or have no id and share a text, are one
document: they keep and lose the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.common import col, stored, utf8
from tessera.session import remove

SENTENCES, WORDS, LONG = 3, 20, 20
#: Words of a run that is a span wherever it begins, and of an anchor in it.
RUN, ANCHOR = 50, 20
_END, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_END[list(b".!?")] = True
_BREAK[list(b",;:")] = True
#: Last bytes of words that end a sentence besides those of ``_END``: other full
#: stops, and closing quotes and brackets after any full stop.
_STOPS = ("\u3002", "\uff01", "\uff1f", "\uff0e", "\u0964", "\u0965", "\u061f", "\u06d4", "\u2026")
_CLOSING = "\"')]}\u201d\u2019\u00bb\u203a\u300d\u300f\uff09\u3011"
#: Last two bytes that these characters can have.
_TAIL = np.zeros((256, 256), bool)
for _c in (*_STOPS, *_CLOSING):
    _TAIL[_c.encode()[-2] if ord(_c) > 127 else slice(None), _c.encode()[-1]] = True
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def _ends(text: bytes, stops: np.ndarray) -> np.ndarray:
    """Whether each word (given by its end) ends a sentence."""
    data = np.frombuffer(text, np.uint8)
    last = data[stops - 1]
    ends = _END[last].copy()
    for i in np.flatnonzero(_TAIL[data[np.maximum(stops - 2, 0)], last]):
        tail = text[max(stops[i] - 16, 0) : stops[i]].decode("utf-8", "ignore").rstrip(_CLOSING)
        ends[i] = tail.endswith((".", "!", "?", *_STOPS))
    return ends


def _sentence_spans(text: bytes, starts: np.ndarray, stops: np.ndarray, offsets: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word + 1 of every span of whole sentences of one text."""
    data = np.frombuffer(text, np.uint8)
    ends = _ends(text, stops)
    lines = np.searchsorted(starts, np.flatnonzero(data == 10)) - 1
    ends[lines[lines >= 0]] = True
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    sentence = np.cumsum(ends) - ends
    ends |= _BREAK[data[stops - 1]] & (np.bincount(sentence)[sentence] > LONG)
    after = np.flatnonzero(ends) + 1  # word after each sentence
    first = np.zeros_like(after)
    first[1:] = after[:-1]
    upto = np.maximum(np.arange(len(first)) + sentences, np.searchsorted(after, first + words) + 1)
    whole = upto <= np.searchsorted(after, offsets, "right")[np.searchsorted(offsets, first, "right")]
    return first[whole], after[upto[whole] - 1]


def _sums(w: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... words' hashes, each times its power."""
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * S.powers(len(w))[0], out=total[1:])
    return total


def _changes(of: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)


def _run_anchors(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 20-word hashes, the first word of each run of ``RUN`` words of one text, and the place of the smallest hash in it."""
    width = RUN - ANCHOR + 1
    if len(hashes) < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    _, inverse = S.powers(len(hashes))
    total = _sums(hashes)
    grams = S.mix((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: 1 - ANCHOR])
    of, least, size = np.arange(len(grams)), grams, 1
    while size < width:  # the smallest of the first ``size`` from each place on; of equal ones the first
        step = min(size, width - size)
        later = least[step:] < least[:-step]
        of, least = np.where(later, of[step:], of[:-step]), np.where(later, least[step:], least[:-step])
        size += step
    n = np.maximum(np.diff(offsets) - RUN + 1, 0)
    run = np.repeat(offsets[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return grams, run, of[run]


def _anchors(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of the anchors of a block of texts."""
    grams, _, of = _run_anchors(hashes, offsets)
    at = of[_changes(of)]  # the places only rise
    text = np.searchsorted(offsets, at, "right") - 1
    return text, at - offsets[text], grams[at]


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors among a text's word hashes."""
    return _anchors(hashes, np.array([0, len(hashes)]))[1:]


def _hash(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for the words ``a[i]:b[i]`` of each i."""
    total = _sums(w)
    return S.mix((total[b] - total[a]) * S.powers(len(w))[1][a] + (b - a).astype(np.uint64))


def _spans(text: bytes, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, ...]:
    """(first word, last word + 1, hash, second hash) of the sentence spans of a block of texts that are no run of ``RUN`` words."""
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    a, b = _sentence_spans(text, starts, stops, offsets, sentences, words)
    other = b - a != RUN
    a, b = a[other], b[other]
    return a, b, _hash(hashes, a, b), _hash(S.mix(hashes ^ _OTHER), a, b)


def spans(text: bytes, sentences: int = SENTENCES, words: int = WORDS, runs: bool = True) -> tuple[np.ndarray, ...]:
    """(first byte, last byte + 1, words, hash, second hash) of every span of a text, by place.

    Without ``runs`` only spans of whole sentences that are no run of ``RUN`` words.
    """
    starts, stops, hashes = S.words(text)
    n = len(starts)
    a, b, hi, lo = _spans(text, starts, stops, hashes, np.array([0, n]), sentences, words)
    if runs:
        run = np.arange(max(n - RUN + 1, 0))
        a, b = np.concatenate([a, run]), np.concatenate([b, run + RUN])
        hi, lo = (np.concatenate([h, _hash(w, run, run + RUN)]) for h, w in ((hi, hashes), (lo, S.mix(hashes ^ _OTHER))))
        by = np.lexsort((b, a))
        a, b, hi, lo = a[by], b[by], hi[by], lo[by]
    return starts[a], stops[b - 1], b - a, hi, lo


def _blocks(starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, near: np.ndarray | None = None, begins: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The blocks of texts with their anchor at one of the words ``near``, or that begin at one of the bytes ``begins``.

    First (first word, first byte, last byte + 1, runs, anchor, hash, second
    hash) of each block, where the second hash is also of the white space
    between the words, then (block, first byte, last byte + 1, hash, second
    hash) of each run in these blocks, if ``begins`` are given.
    """
    grams, run, of = _run_anchors(hashes, offsets)
    change = _changes(of)
    first, size = run[change], np.diff(np.r_[change, len(of)])
    mine = np.isin(of[change], near) if begins is None else np.isin(starts[first], begins)
    a, n, anchor = first[mine], size[mine], grams[of[change[mine]]]
    b = a + n + RUN - 1
    other = S.mix(hashes ^ _OTHER)
    gaps = np.r_[starts[1:] - stops[:-1], np.zeros(min(len(starts), 1), np.int64)].astype(np.uint64)
    gaps[offsets[1:][np.diff(offsets) > 0] - 1] = 0  # white space between texts
    found = a, starts[a], stops[b - 1], n, anchor, _hash(hashes, a, b), _hash(S.mix(other + gaps), a, b)
    block = np.repeat(np.arange(len(a)), n if begins is not None else 0)
    x = a[block] + np.arange(len(block)) - (np.cumsum(n) - n)[block] if len(block) else block
    return found, (block, starts[x], stops[x + RUN - 1], _hash(hashes, x, x + RUN), _hash(other, x, x + RUN))


def _document(docs: DataFrame, id_col: str, text_col: str) -> list:
    """What tells documents apart: no_id, ord (the id, or a hash of the text), h (of the text)."""
    text = F.coalesce(col(text_col), F.lit(""))
    kind = "long" if docs.select(col(id_col)).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    own = F.coalesce(col(id_col).cast(kind), F.xxhash64(text).cast(kind))
    return [col(id_col).isNull().alias("no_id"), own.alias("ord"), F.hash(text).alias("h")]


def _anchored(docs: DataFrame, id_col: str, text_col: str, made: list[str]) -> DataFrame:
    """(no_id, ord, h, text, anchors): documents with anchors that occur twice in the table."""

    def cut(block: tuple, _: np.ndarray, __: np.ndarray) -> tuple[np.ndarray, ...]:
        *_, hashes, offsets = block
        return _anchors(hashes, offsets)

    rows = docs.select(*_document(docs, id_col, text_col), F.encode(col(text_col), "utf-8").alias("text"))
    found = stored(_cut_rows(rows, None, cut, _ANCHORS), "anchors", made)
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    near = found.join(twice, "anchor").groupBy("no_id", "ord", "h").agg(F.collect_set("at").alias("anchors"))
    return rows.join(near, ["no_id", "ord", "h"])


#: Columns of the rows that are cut out of texts, besides the document's.
_ANCHORS = {"at": "int", "anchor": "long"}
_SPANS = {"start": "int", "stop": "int", "hi": "long", "lo": "long"}
_BLOCKS = {"start": "int", "stop": "int", "runs": "int", "anchor": "long", "hi": "long", "lo": "long"}
_RUNS = {"begin": "int", "block_hi": "long", "block_lo": "long", **_SPANS}


def _cut_rows(docs: DataFrame, given: str | None, cut_block: Callable[..., tuple[np.ndarray, ...]], columns: dict[str, str]) -> DataFrame:
    """(no_id, ord, h, columns): the rows that ``cut_block`` makes of the documents' texts and column ``given`` (places).

    It is called with many texts at once (bytes, begins, starts, stops, hashes
    and offsets of ``shingles.located``) and with the text and the value of each
    place, and returns the text (from 0) of each row before the columns.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [np.int32 if t == "int" else np.int64 for t in columns.values()]
        for b in batches:
            parts, size = [], 0
            texts, places = np.empty(0, np.int64), np.empty(0, np.int64)
            if given:
                texts, places = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_parent_indices(b.column(given)), b.column(given).flatten()))
            for first, last, *block in S.located(utf8(b.column("text"))):
                mine = slice(*np.searchsorted(texts, [first, last]))
                of, *values = cut_block(block, texts[mine] - first, places[mine])
                parts.append((of + first, *values))
                size += len(of)
                if size > 100_000 or last == b.num_rows:  # Arrow batches of bounded size
                    of, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
                    row = pa.array(of)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("no_id", "ord", "h")), *(pa.array(x.astype(t)) for x, t in zip(values, types, strict=True))], ["no_id", "ord", "h", *columns])
                    parts, size = [], 0

    rows = docs.select("no_id", "ord", "h", "text", *([given] if given else []))
    kind = docs.schema["ord"].dataType.simpleString()
    return rows.mapInArrow(cut, f"no_id boolean, ord {kind}, h int, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def _sentence_rows(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """(no_id, ord, h, start, stop, hi, lo): one row for each span of whole sentences."""

    def cut(block: tuple, _: np.ndarray, __: np.ndarray) -> tuple[np.ndarray, ...]:
        data, begins, starts, stops, hashes, offsets = block
        a, b, hi, lo = _spans(data, starts, stops, hashes, offsets, sentences, words)
        text = np.searchsorted(offsets, a, "right") - 1
        return text, starts[a] - begins[text], stops[b - 1] - begins[text], hi, lo

    return _cut_rows(docs, None, cut, _SPANS)


def _block_rows(docs: DataFrame) -> DataFrame:
    """(no_id, ord, h, start, stop, runs, anchor, hi, lo): the blocks that have one of ``anchors``."""

    def cut(block: tuple, of: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
        _, begins, starts, stops, hashes, offsets = block
        first, start, stop, *rest = _blocks(starts, stops, hashes, offsets, near=near + offsets[of])[0]
        text = np.searchsorted(offsets, first, "right") - 1
        return text, start - begins[text], stop - begins[text], *rest

    return _cut_rows(docs, "anchors", cut, _BLOCKS)


def _run_rows(docs: DataFrame) -> DataFrame:
    """(no_id, ord, h, begin, block_hi, block_lo, start, stop, hi, lo): the runs of the blocks that begin at ``begins``."""

    def cut(block: tuple, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        _, begins, starts, stops, hashes, offsets = block
        (first, begin, _, _, _, hi, lo), (own, start, stop, *rest) = _blocks(starts, stops, hashes, offsets, begins=at + begins[of])
        text = (np.searchsorted(offsets, first, "right") - 1)[own]
        return text, begin[own] - begins[text], hi[own], lo[own], start - begins[text], stop - begins[text], *rest

    return _cut_rows(docs, "begins", cut, _RUNS)


def _repeated_runs(anchored: DataFrame, made: list[str]) -> DataFrame:
    """(no_id, ord, h, start, stop, first): what non-first occurrences of runs of ``RUN`` words cover.

    A block that isn't the first of its kind goes whole, and each document that
    has the first occurrence of one of its runs keeps them. Of the first block
    of a kind those runs go that occur before in blocks of other kinds.
    """
    every = stored(_block_rows(anchored), "repeated-blocks", made)
    kinds = every.groupBy("hi", "lo").agg(F.min(F.struct("no_id", "ord", "start", "h")).alias("rep"), F.min("anchor").alias("anchor"), F.min("runs").alias("runs"), F.count(F.lit(1)).alias("n"))
    kinds = stored(kinds, "kinds-of-blocks", made)
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    begins = kinds.join(several, "anchor").groupBy("rep.no_id", "rep.ord", "rep.h").agg(F.collect_set("rep.start").alias("begins"))
    runs = stored(_run_rows(anchored.join(begins, ["no_id", "ord", "h"])), "runs-of-blocks", made)
    place = F.struct("no_id", "ord", "start")
    firsts = runs.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", "first")
    run = F.struct((F.col("start") - F.col("begin")).alias("a"), (F.col("stop") - F.col("begin")).alias("b"), F.col("first.no_id").alias("no_id"), F.col("first.ord").alias("ord"))
    lost = runs.join(firsts, ["hi", "lo"]).where(place != F.col("first")).groupBy(F.col("block_hi").alias("hi"), F.col("block_lo").alias("lo")).agg(F.collect_set(run).alias("lost"))
    known = kinds.join(lost, ["hi", "lo"], "left").where("n > 1 OR lost IS NOT NULL").select("hi", "lo", "rep", "lost", F.col("runs").alias("all"))
    doc = lambda x: F.struct(x["no_id"].alias("no_id"), x["ord"].alias("ord"))
    lost, rep = F.coalesce("lost", F.array().cast(known.schema["lost"].dataType)), F.col("rep")
    keepers = F.array_distinct(F.concat(F.transform(lost, doc), F.when(F.size(lost) < F.col("all"), F.array(doc(rep))).otherwise(F.array().cast(f"array<struct<no_id:boolean,ord:{every.schema['ord'].dataType.simpleString()}>>"))))
    gap = lambda start, stop, first: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), first.alias("first"))
    whole = F.transform(keepers, lambda x: gap(F.col("start"), F.col("stop"), x))
    some = F.transform(lost, lambda x: gap(F.col("start") + x["a"], F.col("start") + x["b"], doc(x)))
    is_rep = place == F.struct(rep["no_id"], rep["ord"], rep["start"])
    gone = every.join(known, ["hi", "lo"]).select("no_id", "ord", "h", F.explode(F.when(is_rep, some).otherwise(whole)).alias("gap"))
    return gone.select("no_id", "ord", "h", "gap.start", "gap.stop", "gap.first")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(no_id, ord, h, start, stop, first): what the non-first occurrences of spans cover.

    ``start`` and ``stop`` are bytes of the text in UTF-8, of one span or of
    consecutive runs of words; ``first`` is a document (no_id, ord) with an
    occurrence that stays. A span may repeat within one document. Documents
    without id come last in the order. Null and empty texts and texts of fewer
    sentences and words have no spans. A span that a third of all documents
    share is pre-aggregated when counted and split like any skewed key when
    joined.
    """
    made: list[str] = []
    anchored = stored(_anchored(docs, id_col, text_col, made), "repeated-anchors", made)
    runs = stored(_repeated_runs(anchored, made), "repeated-runs")
    remove(docs.sparkSession, made)  # only the runs are read from here on
    every = docs.select(*_document(docs, id_col, text_col), F.encode(col(text_col), "utf-8").alias("text"))
    rows = _sentence_rows(every, sentences, words)
    place = F.struct("no_id", "ord", "start")
    firsts = rows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(firsts.select("hi", "lo", "first"), "repeated-spans")
    joined = rows.join(firsts, ["hi", "lo"]).where(place != F.col("first"))
    return joined.select("no_id", "ord", "h", "start", "stop", F.struct("first.no_id", "first.ord").alias("first")).unionByName(runs)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(id, text, removed_bytes, removed, first_ids) of every document that loses sentences.

    ``removed`` lists the merged byte ranges that went, ``first_ids`` the
    documents that keep them (null: one without id). Documents without
    repeated spans are not in the result: they stay as they are. Repeated
    rows give a row each. Other columns are ignored; an empty table gives an
    empty result.
    """
    gone = repeated_spans(docs, id_col, text_col, sentences, words)
    first_id = F.when(~F.col("first.no_id"), F.col("first.ord"))
    firsts = F.sort_array(F.collect_set(F.struct(first_id.alias("id"))))
    cuts = gone.groupBy("no_id", "ord", "h").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"), firsts.alias("firsts"))
    texts = docs.select(col(id_col).alias("id"), *_document(docs, id_col, text_col), F.encode(col(text_col), "utf-8").alias("text"))
    cut = texts.join(cuts, ["no_id", "ord", "h"]).select("id", "text", "ranges", "firsts.id").toDF("id", "text", "ranges", "first_ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lost, merged = [], [], []
            for text, ranges in zip(utf8(b.column("text")), b.column("ranges").to_pylist(), strict=True):
                kept, removed, at = [], [], 0
                for r in ranges:
                    if removed and r["start"] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], r["stop"])
                    else:
                        removed.append([r["start"], r["stop"]])
                for start, stop in removed:
                    kept.append(text[at:start])
                    at = stop
                kept.append(text[at:])
                texts.append(b"".join(kept).decode())
                lost.append(sum(y - x for x, y in removed))
                merged.append(removed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(texts, pa.string()), pa.array(lost, pa.int64()), pa.array(merged, pa.list_(pa.list_(pa.int64()))), b.column("first_ids")],
                ["id", "text", "removed_bytes", "removed", "first_ids"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    return cut.mapInArrow(apply, f"id {kinds['id']}, text string, removed_bytes long, removed array<array<long>>, first_ids {kinds['first_ids']}")
