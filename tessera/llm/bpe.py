"""BPE encoding and decoding with a deterministic tokenization automaton.

The merges of a tokenizer file are compiled one after the other. The states of
the automaton are the tokens read last, its arcs are tokens. In the beginning
every symbol has a state from which all tokens may follow. The gadget of a
merge ``(u, v) -> w`` does three things: the new arc ``w`` runs wherever ``u``
ran and leads to a copy of ``v``'s state; ``u``'s state loses its arc ``v``;
and with it all arcs that later merges build on that ``v``. What results
accepts exactly one token sequence for each string, the one that the merges
give.

Tokens are numbered in preorder of the tree "left part of", later merges
first. What a gadget removes is then one interval of numbers, and a state is a
short sorted list of removed intervals: the whole automaton of 49,000 tokens
takes some MB instead of a table of 49,000 squared.

A word is encoded by table-driven transitions: from each place the arcs whose
labels match the text are followed where the state has them, the longest
first, until the word's end. Decoding emits the labels of the arcs that the ids name. Texts are
cut into words as the file says (normalizer and pre-tokenizer); words seen
before come from a cache of bounded size, and no word is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import col
from tessera.llm.token_counts import STABLE

#: How word-level BPE normalises texts and cuts them into words,
#: as the tokenizer file states it, and the same cut for lower-cased ASCII texts.
NORMALIZER = ["NFC", ("Replace", r"\s+", " "), "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
#: White space beyond ASCII that the pattern's ``\s`` means.
SPACES = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words up to this length are remembered; tokens in one Arrow batch.
LONGEST_CACHED, BATCH_TOKENS = 64, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Automaton:
    """Compiled merges. ``rank``: number of a token in preorder, by id (-1: no arc has it).

    The state of rank ``s`` lacks the arcs ``first[i]`` to ``last[i]`` for the
    i from ``begin[s]`` to ``begin[s + 1]``, ascending and apart.
    """

    rank: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    last: np.ndarray


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> Automaton:
    """The automaton of ``merges``, built gadget by gadget.

    A merge whose parts can't meet any more is dead and adds no arc. Parts
    that no earlier merge makes, or a token that two merges make, raise
    ValueError: such a list has no left-to-right order of gadgets.
    """
    ids = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
    size = max(vocab.values()) + 1
    made = [w for _, _, w in ids]
    if len(set(made)) != len(made):
        raise ValueError("two merges make one token")
    symbol = np.ones(size, bool)
    symbol[made] = False
    known = symbol.copy()
    children: list[list[int]] = [[] for _ in range(size)]
    for u, v, w in ids:
        if not (known[u] and known[v]):
            raise ValueError("a merge comes before its parts")
        known[w] = True
        children[u].append(w)
    below = np.ones(size, np.int64)  # tokens in the subtree
    for u, _, w in reversed(ids):
        below[u] += below[w]
    rank = np.full(size, -1, np.int64)
    at, stack = 0, [t for t in sorted(set(vocab.values()), reverse=True) if symbol[t]]
    while stack:
        t = stack.pop()
        rank[t], at = at, at + 1
        stack.extend(children[t])  # the latest child is numbered first
    order, later, dead = rank.tolist(), (below - 1).tolist(), set()
    below = below.tolist()
    # A token that ends a word is followed by nothing and needs no state.
    open_ = {i for t, i in vocab.items() if not (suffix and t.endswith(suffix))}
    lost = {t: (array("q"), array("q")) for t in open_ if symbol[t]}
    for u, v, w in ids:
        if u in dead or v in dead or u not in lost or any(a <= order[v] <= b for a, b in zip(*lost[u], strict=True)):
            dead.add(w)
        else:
            if w in open_:
                lost[w] = lost[v][0][:], lost[v][1][:]
            lost[u][0].append(order[v])
            lost[u][1].append(order[v] + later[v])
        later[u] -= below[w]
    state = np.repeat(rank[list(lost)], [len(a) for a, _ in lost.values()]) * size
    first = np.concatenate([np.frombuffer(a, np.int64) for a, _ in lost.values()] or [state]) + state
    last = np.concatenate([np.frombuffer(b, np.int64) for _, b in lost.values()] or [state]) + state
    by = np.lexsort((-last, first))
    first, last = first[by], last[by]
    outer = np.r_[True, first[1:] > np.maximum.accumulate(last)[:-1]] if len(first) else np.empty(0, bool)
    first, last = first[outer], last[outer]
    begin = np.searchsorted(first, np.arange(size + 1) * size)
    base = np.repeat(np.arange(size) * size, np.diff(begin))
    rank[list(dead)] = -1
    return Automaton(rank.astype(np.int32), begin, (first - base).astype(np.int32), (last - base).astype(np.int32))


class _Words(dict):
    """Word -> ids: those met by this worker, ``room`` at most. When half the room is used up
    the words are set aside; those met again come back, the others go the next time."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]], room: int):
        super().__init__()
        self.encode, self.room, self.aside = encode, room, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.aside.get(word) or self.encode(word)
        if len(word) <= LONGEST_CACHED:
            if 2 * len(self) >= self.room:
                self.aside = dict(self)
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Compiled:
    """What a tokenizer file says, with its merges compiled: some MB, bounded by the vocabulary."""

    path: str
    automaton: Automaton
    vocab: dict[str, int]
    suffix: str
    labels: list[str | None]
    added: dict[str, int]
    plain_cut: bool
    decoder: bool


def _cuts_plainly(spec: dict) -> bool:
    """Whether the file cuts words as ``NORMALIZER`` and ``PATTERN`` do."""
    steps = [n["type"] if n["type"] != "Replace" else ("Replace", n["pattern"].get("Regex"), n["content"]) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == NORMALIZER
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PATTERN}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
    )


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def compile_file(path: str) -> Compiled:
    """Compiles a file of the ``tokenizers`` library that holds a plain BPE model (others raise ValueError)."""
    library = _library(path)
    spec = json.loads(library.to_str())
    model, added = spec["model"], library.get_added_tokens_decoder()
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd:
        raise ValueError(f"no plain BPE model: {model['type']} {odd}")
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError("added tokens must stand for their own characters only")
    suffix = model.get("end_of_word_suffix") or ""
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    by_id = {i: token for token, i in library.get_vocab().items()}
    return Compiled(
        path,
        compile_merges(model["vocab"], merges, suffix),
        model["vocab"],
        suffix,
        [by_id.get(i) for i in range(max(by_id) + 1)],
        {t.content: i for i, t in added.items()},
        _cuts_plainly(spec),
        spec["decoder"] is not None,
    )


class Encoder:
    """Encoder of one compiled file; ``room`` words are remembered.

    The library itself is loaded only for texts with code points that it must
    class, and for files that cut words otherwise.
    """

    def __init__(self, compiled: Compiled, room: int = 300_000):
        self.compiled, self.suffix = compiled, compiled.suffix
        self._tables()
        names = sorted(map(re.escape, compiled.added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(names)})" if names else r"((?!))")
        self.bytes = byte_symbols()
        self.ascii, self.wide = re.compile(ASCII_PATTERN), regex.compile(PATTERN.replace(r"[^\s", rf"[^ \t-\r{SPACES}"))
        self.unstable = re.compile(f"[^{STABLE}]")
        self.raw = _Words(lambda w: self.word("".join(map(self.bytes.__getitem__, w.encode()))), room)
        self.cut = _Words(self.word, room)

    @cached_property
    def library(self):
        return _library(self.compiled.path)

    def _tables(self) -> None:
        """Labels of the arcs as a tree of symbols, with (token, rank) at the key "" where a label
        ends; for each state (a token) the first and the last of each run of arcs it lacks."""
        self.tree: dict = {}
        automaton = self.compiled.automaton
        rank, begin = automaton.rank.tolist(), automaton.begin.tolist()
        for label, i in self.compiled.vocab.items():
            if rank[i] < 0:
                continue
            at = self.tree
            for s in self._symbols(label.removesuffix(self.suffix), label.endswith(self.suffix)) if self.suffix else label:
                at = at.setdefault(s, {})
            at[""] = i, rank[i]
        none = array("i"), array("i", [-1])
        lacks = [none if a == b else (array("i", automaton.first[a:b].tobytes()), array("i", [-1]) + array("i", automaton.last[a:b].tobytes())) for a, b in zip(begin, begin[1:])]
        self.lacks = [lacks[max(r, 0)] for r in rank]

    def _symbols(self, word: str, whole: bool) -> list[str]:
        symbols = list(word)
        if whole and symbols:
            symbols[-1] += self.suffix
        return symbols

    def _arcs(self, symbols: list[str], begin: int) -> list[tuple[int, int, int]]:
        """(token, rank, end) of the arcs whose labels match from a place on, the longest last."""
        at, found = self.tree, []
        for end in range(begin, len(symbols)):
            at = at.get(symbols[end])
            if at is None:
                break
            arc = at.get("")
            if arc is not None:
                found.append((*arc, end + 1))
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given in byte symbols.

        The longest arc that the state has is followed first. A place is
        reached in one state only, so one that leads nowhere is never tried again.
        """
        if not word:
            return ()
        symbols, lacks = self._symbols(word, True), self.lacks
        path, ahead, dead = [], [self._arcs(symbols, 0)], set()
        first, last = (), (-1,)  # nothing is lacking at the start
        while ahead:
            arcs = ahead[-1]
            while arcs:
                token, rank, end = arcs.pop()
                if end not in dead and last[bisect_right(first, rank)] < rank:
                    break
            else:
                ahead.pop()
                if path:
                    dead.add(path.pop()[1])
                first, last = lacks[path[-1][0]] if path else ((), (-1,))
                continue
            path.append((token, end))
            if end == len(symbols):
                return tuple([t for t, _ in path])
            ahead.append(self._arcs(symbols, end))
            first, last = lacks[token]
        raise ValueError(f"no tokens for {word!r}")

    def encode(self, text: str | None) -> list[int]:
        """Ids as the library's ``encode(text, add_special_tokens=False)`` gives them; null counts as empty."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text or "")):
            if k % 2:
                out.append(self.compiled.added[part])
            elif part and self.compiled.plain_cut and part.isascii():
                out.extend(chain.from_iterable(map(self.raw.__getitem__, self.ascii.findall(part.lower()))))
            elif part and self.compiled.plain_cut and not self.unstable.search(part):
                # Letters are lower-cased one by one: a final sigma is like any other.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.extend(chain.from_iterable(map(self.raw.__getitem__, self.wide.findall(plain))))
            elif part:
                plain = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                cut = self.library.pre_tokenizer.pre_tokenize_str(plain) if self.library.pre_tokenizer else [(plain, None)]
                out.extend(chain.from_iterable(self.cut[w] for w, _ in cut))
        return out


class Decoder:
    """Decoder of one compiled file: its arcs' labels by id."""

    def __init__(self, path: str, labels: list[str | None], decoder: bool):
        self.labels = pa.array(labels, pa.string())
        self.decoder = _library(path).decoder if decoder else None

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts as the library's ``decode(ids, skip_special_tokens=False)`` gives them."""
        arcs = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), self.labels.take(ids.flatten()))
        if self.decoder is None:
            return pc.binary_join(arcs, " ")
        return pa.array((self.decoder.decode(x) for x in arcs.to_pylist()), pa.string())


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(compiled: Compiled, room: int) -> Encoder:
    """The worker's encoder of a file; its words live as long as the worker."""
    key = compiled.path, room
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(compiled, room)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 300_000) -> DataFrame:
    """(id, ids) of every whole text, one row for each row of ``docs``.

    ``path``: file of the ``tokenizers`` library with a BPE model, readable on
    every worker. It is compiled once on the driver and broadcast: some MB,
    bounded by the vocabulary. Special strings inside a text become their own
    ids, as the library does by default. A null or empty text has no ids; a
    text of any length is encoded whole, in memory in proportion to it, and a
    word of any length in time in proportion to it. Repeated rows and null ids
    are kept as they are; other columns are ignored, whatever their names; an
    empty table gives an empty result. ``room`` words are remembered per worker.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(compile_file(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(compiled.value, room)
        for b in batches:
            flat, offsets, begin = array("i"), [0], 0
            for i, text in enumerate(b.column(1)):
                flat.extend(encoder.encode(text.as_py()))
                offsets.append(len(flat))
                if len(flat) > BATCH_TOKENS or i == b.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, i + 1 - begin), lists], ["id", "ids"])
                    flat, offsets, begin = array("i"), [0], i + 1

    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; null ids give a null text.

    All rows and columns stay as they are. No ids give an empty text, an
    unknown id raises. Long rows make batches of their own.
    """
    from pyspark.sql.types import StringType, StructType

    compiled = compile_file(path)
    said = encoded.sparkSession.sparkContext.broadcast((compiled.labels, compiled.decoder))
    schema = StructType([*encoded.schema.fields]).add(out_col, StringType())
    plain = StructType()
    for i, f in enumerate(schema.fields):
        plain.add(f"c{i}", f.dataType, True)
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path, *said.value)
        for b in batches:
            begin, sizes = 0, pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes)
            while begin < b.num_rows:
                done = total[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(total, done + BATCH_TOKENS, "right")))
                part = b.slice(begin, stop - begin)
                ids = part.column(at)
                texts = decoder.decode(ids if not ids.null_count else pc.fill_null(ids, pa.scalar([], ids.type)))
                texts = pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=plain.names)
                begin = stop

    return encoded.toDF(*plain.names[:-1]).mapInArrow(decode, plain).toDF(*schema.names)
