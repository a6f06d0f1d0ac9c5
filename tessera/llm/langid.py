"""Language identification by character language models.

One interpolated Kneser-Ney model of character n-grams for each language,
learned from a bounded sample of labelled texts. A word is a run of letters,
lower-cased, between two boundary marks; n-grams stay inside words. A model is
a pair of sorted arrays for each order: n-gram hash -> log probability and
context hash -> log backoff weight, looked up by binary search. A text gets
the language of the lowest cross-entropy per character. A text that fits even
that model worse than calibration allows is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, filter_batches
from tessera.llm.shingles import mix

UNKNOWN = "und"
#: Labels that are learned at most, those of the most different texts; their counts (one row each) are broadcast.
MAX_LABELS = 10_000
_WORD = regex.compile(r"\p{L}+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
Table = tuple[np.ndarray, np.ndarray]


def _positions(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of the marked words.

    Returns (hashes by order 1..order, place in the word, word). The mark
    before a word has place 0, the mark after it is predicted like a character.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer(("\0" + "\0\0".join(words) + "\0").encode("utf-32-le"), np.uint32) if words else np.empty(0, np.uint32)
    chars = chars.astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(chars)) - starts[word]
    hashes = [mix(chars)]
    for _ in range(order - 1):
        previous = np.r_[np.uint64(0), hashes[-1][:-1]]
        hashes.append(mix(previous * _MUL + chars))
    return hashes, place, word


def _find(table: Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of each key in a sorted hash array."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


@dataclass
class CharModel:
    """Interpolated Kneser-Ney model of one language, in bits."""

    order: int
    alphabet: int
    ngrams: list[Table] = field(default_factory=list)
    backoffs: list[Table] = field(default_factory=list)

    @classmethod
    def fit(cls, words: list[str], order: int, alphabet: int) -> CharModel:
        """``alphabet``: number of different characters, seen or not (uniform floor)."""
        hashes, place, _ = _positions(words, order)
        model = cls(order, alphabet)
        keep = place > 0
        grams = []
        for n in range(1, order + 1):
            at = np.flatnonzero(keep & (place >= n - 1))
            keys, first, raw = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
            ends = at[first]
            context = hashes[n - 2][ends - 1] if n > 1 else np.zeros(len(keys), np.uint64)
            suffix = hashes[n - 2][ends] if n > 1 else context
            grams.append((keys, raw.astype(float), context, suffix, place[ends] == n - 1))
        lower: Table | None = None
        for n in range(1, order + 1):
            keys, counts, context, suffix, at_start = grams[n - 1]
            if n < order:  # lower orders count the different characters before
                left_keys, left = np.unique(grams[n][3], return_counts=True)
                _, extended = _find((left_keys, left.astype(float)), keys)
                counts = np.where(at_start & (n > 1), counts, np.maximum(extended, 1))
            once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = once / (once + 2 * twice) if once else 0.5
            contexts, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            weight = discount * kinds / total
            below = _find(lower, suffix)[1] if lower is not None else np.full(len(keys), 1.0 / alphabet)
            p = (counts - discount) / total[of] + weight[of] * below
            lower = (keys, p)
            model.ngrams.append((keys, np.log2(p).astype(np.float32)))
            model.backoffs.append((contexts, np.log2(weight).astype(np.float32)))
        return model

    def bits(self, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Bits of each character of the marked words (0 at the marks before them)."""
        out = np.zeros(len(place))
        open_at = np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            at = open_at[place[open_at] >= n - 1]
            found, value = _find(self.ngrams[n - 1], hashes[n - 1][at])
            out[at[found]] -= value[found]
            rest = at[~found]
            if n > 1:
                seen, weight = _find(self.backoffs[n - 1], hashes[n - 2][rest - 1])
                out[rest[seen]] -= weight[seen]
            else:
                empty, weight = _find(self.backoffs[0], np.zeros(len(rest), np.uint64))
                out[rest] += np.log2(self.alphabet) - np.where(empty, weight, 0.0)
            solved = np.zeros(len(place), bool)
            solved[at[found]] = True
            open_at = open_at[~solved[open_at]]
        return out


@dataclass
class LanguageId:
    """Models of all languages and the calibration of score and rejection."""

    labels: list[str]
    models: list[CharModel]
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    char_spread: np.ndarray | None = None
    limit: np.ndarray | None = None


class _Scorer(dict):
    """White-space token -> row of ``bits``; scores new tokens many at a time."""

    ROOM = 300_000  # tokens remembered before a worker starts afresh
    GROUP_CHARS = 1 << 20  # texts are summed in groups of about so many characters

    def __init__(self, model: LanguageId):
        super().__init__()
        self.model, self.pending = model, []
        self.bits = np.zeros((1 << 14, len(model.models) + 1))

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self)
        self.pending.append(token)
        return row

    def _score_pending(self) -> None:
        words, of = [], []
        for i, token in enumerate(self.pending, len(self) - len(self.pending)):
            found = _WORD.findall(token.lower())
            words += found
            of += [i] * len(found)
        self.pending = []
        while len(self.bits) < len(self):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        if not words:
            return
        of, size = np.asarray(of), len(self)
        if not self.model.models:
            self.bits[:size, -1] += np.bincount(of, minlength=size)
            return
        hashes, place, word = _positions(words, self.model.models[0].order)
        row = of[word]
        for j, m in enumerate(self.model.models):
            self.bits[:size, j] += np.bincount(row, m.bits(hashes, place), size)
        self.bits[:size, -1] += np.bincount(row, place > 0, size)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """For each text: bits under each model, then the number of predicted characters."""
        out = np.zeros((len(texts), self.bits.shape[1]))
        at = 0
        while at < len(texts):
            if len(self) > self.ROOM:
                self.clear()
                self.bits[:] = 0
            group, chars = [], 0
            while at + len(group) < len(texts) and (chars < self.GROUP_CHARS or not group):
                tokens = (texts[at + len(group)] or "").split()
                group.append(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))
                chars += len(texts[at + len(group) - 1] or "")
            if self.pending:
                self._score_pending()
            for i, rows in enumerate(group, at):
                if len(rows):
                    out[i] = self.bits[rows].sum(axis=0)
            at += len(group)
        return out


def _judge(model: LanguageId, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best model, score, rejected) of texts that have letters."""
    n = sums[:, -1]
    entropy = sums[:, :-1] / n[:, None]
    best = entropy.argmin(axis=1)
    ahead = np.exp2(-model.sharpness * np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1)[:, None]))
    score = 1.0 / ahead.sum(axis=1)
    z = (entropy.min(axis=1) - model.mean[best]) / np.sqrt(model.spread[best] ** 2 + model.char_spread[best] ** 2 / n)
    return best, score, z > model.limit[best]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order: int = 4, per_label: int = 800, reject_z: float = 8.0, seed: int = 3) -> LanguageId:
    """Learn from at most ``per_label`` different labelled texts of each language.

    The sample takes whole texts, those whose seeded hash is lowest, so it is
    the same on every run. Copies of a text count once in a language. Three of four learn the models, the fourth
    calibrates them: mean and spread of the cross-entropy of each language, the
    sharpness of the score, and the limit of rejection, at least ``reject_z``
    and ``reject_z`` spreads above the median of that language's calibration
    texts, so that a few junk or mislabelled ones don't move it. Rows without
    text or label are passed over. Of more than ``MAX_LABELS`` labels those with
    the most different texts are learned (ties: the smaller label). Labels are few and each model's size is bounded by the
    sample, so models go through the driver.
    """
    rows = labelled.select(col(text_col).alias("text"), col(label_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("th", F.xxhash64(F.lit(seed), "text"))
    counts = rows.select("lang", "th").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(MAX_LABELS)
    u = F.col("th") / 2.0**64 + 0.5
    near = rows.join(F.broadcast(counts), "lang").withColumn("u", u).where(F.col("u") * F.col("n") < 2.0 * per_label + 20)
    near = near.groupBy("lang", "th").agg(F.min("text").alias("text"), F.min("u").alias("u"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= per_label).select("lang", "text", "rank")

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts, ranks = table.column("text").to_pylist(), table.column("rank").to_pylist()
        kept = [t for t, r in zip(texts, ranks, strict=True) if r % 4 != 0]
        held = [t for t, r in zip(texts, ranks, strict=True) if r % 4 == 0]
        words = [w for t in kept for w in _WORD.findall(t.lower())]
        return pa.table({"lang": [key[0].as_py()], "words": ["\n".join(words)], "held": pa.array([held], pa.list_(pa.string()))})

    parts = sorted(sample.groupBy("lang").applyInArrow(learn, "lang string, words string, held array<string>").collect(), key=lambda r: r["lang"])
    parts = [p for p in parts if p["words"]]
    alphabet = len({c for p in parts for c in p["words"]}) + 1
    model = LanguageId([p["lang"] for p in parts], [CharModel.fit(p["words"].split("\n"), order, alphabet) for p in parts])
    _calibrate(model, [(i, t) for i, p in enumerate(parts) for t in p["held"]], reject_z)
    return model


def _calibrate(model: LanguageId, held: list[tuple[int, str]], reject_z: float) -> None:
    k = len(model.models)
    sums = _Scorer(model).texts([t for _, t in held]) if held else np.zeros((0, k + 1))
    label = np.asarray([i for i, _ in held], np.int64)
    usable = sums[:, -1] > 0 if len(held) else np.zeros(0, bool)
    sums, label = sums[usable], label[usable]
    model.mean, model.spread, model.char_spread = np.full(k, 4.0), np.full(k, 1.0), np.full(k, 4.0)
    model.limit = np.full(k, float(reject_z))
    if not len(sums):
        return
    n = sums[:, -1]
    entropy = sums[:, :-1] / n[:, None]
    own = entropy[np.arange(len(label)), label]
    for j in range(k):
        mine = label == j
        if np.count_nonzero(mine) >= 5:
            e, m = own[mine], n[mine]
            by = np.argsort(e)
            model.mean[j] = e[by][np.searchsorted(np.cumsum(m[by]), m.sum() / 2)]  # weighted median
            deviation = (e - model.mean[j]) ** 2
            model.char_spread[j] = max(np.sqrt(np.median(deviation * m) / 0.455), 1.0)
            model.spread[j] = max(np.sqrt(np.median(deviation) / 0.455), 0.05)
    z = (own - model.mean[label]) / np.sqrt(model.spread[label] ** 2 + model.char_spread[label] ** 2 / n)
    for j in range(k):
        mine = z[label == j]
        if len(mine) >= 5:
            low, middle, high = np.quantile(mine, [0.25, 0.5, 0.75])
            model.limit[j] = max(reject_z, middle + reject_z * (high - low) / 1.349)
    best_loss = np.inf
    for s in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2):
        ahead = -s * np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1)[:, None])
        p = np.exp2(ahead[np.arange(len(label)), label]) / np.exp2(ahead).sum(axis=1)
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best_loss:
            best_loss, model.sharpness = loss, s


def identify(docs: DataFrame, model: LanguageId, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text, one row for each row.

    Null texts and texts without letters are ``und`` with score 0 and are
    rejected, and so is everything if no language was learned. Other columns
    are ignored; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            label, score, rejected = judge_texts(scorer, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def judge_texts(scorer: _Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    sums = scorer.texts(texts)
    label, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    known = np.flatnonzero(sums[:, -1] > 0)
    if len(known) and scorer.model.models:
        best, score[known], rejected[known] = _judge(scorer.model, sums[known])
        for i, j in zip(known, best, strict=True):
            label[i] = scorer.model.labels[j]
    return label, score, rejected


def keep_identified(docs: DataFrame, model: LanguageId, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text isn't rejected, with the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(~judge_texts(scorer, b.column(at).to_pylist())[2]))

    return filter_batches(docs, keep)
