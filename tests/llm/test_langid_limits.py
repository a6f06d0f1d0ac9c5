"""Rejection and sample of the language models."""

from __future__ import annotations

import random
import string

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import langid

JUNK = "qxzv kjwq zzxq vvkj qqwx jxkz wvqz xkqj zvwx qkjz"


def trained() -> tuple[langid.LanguageId, list[tuple[int, str]]]:
    rng = random.Random(3)
    syllables = [["ba", "na", "lo", "mi", "ra", "te"], ["sch", "ung", "ein", "keit", "ver", "ag"]]
    text = lambda j: " ".join("".join(rng.choices(syllables[j], k=3)) for _ in range(40))
    learn = [[text(j) for _ in range(60)] for j in (0, 1)]
    words = [[w for t in ts for w in t.split()] for ts in learn]
    return langid.LanguageId(["a", "b"], [langid.CharModel.fit(w, 4, 27) for w in words]), [(j, text(j)) for j in (0, 1) for _ in range(40)]


def test_a_mislabelled_calibration_text_changes_no_verdict():
    model, held = trained()
    langid._calibrate(model, held, 8.0)
    clean = langid.judge_texts(langid._Scorer(model), [JUNK, *(t for _, t in held)])[2]
    assert clean[0] and not clean[1:].any()
    langid._calibrate(model, [*held, (0, JUNK), (1, JUNK * 3)], 8.0)
    assert (langid.judge_texts(langid._Scorer(model), [JUNK, *(t for _, t in held)])[2] == clean).all()
    assert np.all(model.limit < 20)


def test_foreign_scripts_and_random_letters_are_rejected(spark):
    rng = random.Random(1)
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    letters = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 9))) for _ in range(60)) for _ in range(5)]
    georgian = " ".join("".join(chr(0x10D0 + rng.randrange(33)) for _ in range(6)) for _ in range(60))
    _, _, rejected = langid.judge_texts(langid._Scorer(model), [*letters, georgian])
    assert rejected.all()


def test_copies_of_a_text_count_once(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(10)) for _ in range(120)]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    first = docs.orderBy(F.xxhash64(F.lit(3), "text")).first()["text"]
    copied = docs.union(spark.createDataFrame([(first, "x")] * 500, docs.schema))
    once, often = langid.fit(docs, per_label=80), langid.fit(copied, per_label=80)
    assert [len(k) for k, _ in often.models[0].ngrams] == [len(k) for k, _ in once.models[0].ngrams]
    assert often.mean == once.mean and often.limit == once.limit
    assert not any(r["rejected"] for r in langid.identify(docs, often, "lang").collect())
