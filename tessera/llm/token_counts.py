"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens; a pre-token's number of tokens depends on
nothing but itself. Tier one is a broadcast table of frequent pre-tokens and
their lengths, compact on the wire (one byte string and one byte a length).
What it misses is encoded by the tokenizer once per worker and remembered in
a cache of bounded size. No pre-token is ever shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col

#: The pre-token pattern of byte-level BPE, and the same for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+"
    r"|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
)
#: Code points that every Unicode version since 2012 classes alike. A text with
#: any other goes to the tokenizer as a whole, whose own tables then decide.
STABLE = "\x00-Ԧא-תؠ-يऄ-ह‐-⁤ぁ-ゖァ-ヺ一-鿌가-힣"
LONGEST_CACHED = 64


class _Lengths(dict):
    """Pre-token -> number of tokens: the table's, then those met by this worker."""

    def __init__(self, tokenizer, table: dict[str, int], room: int):
        super().__init__(table)
        self.tokenizer, self.table, self.room = tokenizer, table, room

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= len(self.table) + self.room:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


class TokenCounter:
    """Counts of one tokenizer file, exactly as the library's ``encode`` gives them."""

    def __init__(self, path: str, table: dict[str, int] | None = None, room: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        pre = self.tokenizer.pre_tokenizer
        self.two_tier = (
            plain
            and self.tokenizer.normalizer is None
            and isinstance(pre, pre_tokenizers.ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
        )
        self.special = re.compile("|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) or r"(?!)")
        self.lengths = _Lengths(self.tokenizer, table or {}, room)
        self.ascii, self.wide = re.compile(ASCII_PATTERN), regex.compile(PATTERN)
        self.unstable = re.compile(f"[^{STABLE}]")

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.wide).findall(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.two_tier or not (text.isascii() or not self.unstable.search(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text)
        get = self.lengths.__getitem__
        return len(parts) - 1 + sum(sum(map(get, self.pieces(p))) for p in parts)


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", sample_rows: int = 500, entries: int = 50_000) -> tuple[bytes, bytes]:
    """The most frequent pre-tokens of at most ``sample_rows`` texts and their lengths.

    The table only saves time (a miss is encoded), so a bounded sample, read
    from the first partitions, is enough: at most ``entries`` pre-tokens of at
    most 64 characters, whatever the size of ``docs``.
    """
    counter, seen = TokenCounter(path), Counter()
    if counter.two_tier:
        short = docs.select(col(text_col).alias("t")).where(F.octet_length("t").between(1, 100_000))
        for (text,) in short.limit(sample_rows).collect():
            for part in counter.special.split(text):
                seen.update(p for p in counter.pieces(part) if len(p) <= LONGEST_CACHED)
    kept = [p for p, _ in seen.most_common(entries) if "\0" not in p]
    return "\0".join(kept).encode(), bytes(min(255, counter.lengths[p]) for p in kept)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500, entries: int = 50_000, room: int = 500_000) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, one row for each row of ``docs``.

    ``path``: tokenizer file of the ``tokenizers`` library, readable on every
    worker. Special strings inside a text count as the library counts them by
    default. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and
    null ids are kept as they are; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, text_col, sample_rows, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, lengths = table.value
        known = dict(zip(blob.decode().split("\0"), lengths, strict=True)) if lengths else {}
        counter = TokenCounter(path, known, room)
        for b in batches:
            n = pa.array((counter.count(t) for t in b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(col(id_col).alias("id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
