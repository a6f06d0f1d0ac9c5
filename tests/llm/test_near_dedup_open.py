"""Links that are the only ones of their component, in a group of half-similar texts."""

from __future__ import annotations

import random

import brute
import numpy as np

from tessera.llm import near_dedup


def half_similar(n: int) -> list[tuple[int, str]]:
    """``n`` texts alike at about 0.6, and one partner at exactly 0.75 for each."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    docs = []
    for i in range(n):
        free = list(range(5, 120, 8))
        rng.shuffle(free)
        own = base.copy()
        for p in free[:3]:
            own[p] = f"o{i}x{p}"
        other = own.copy()
        for p in (free[3], free[3] + 3, free[4], free[5]):
            other[p] = f"p{i}x{p}"
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    return docs


def test_no_link_of_a_half_similar_group_is_lost(spark):
    docs = half_similar(400)
    expected = {i: c for i, (_, c) in brute.near_dups(docs).items()}
    assert len(set(expected.values())) > 100
    got = {r["id"]: r["component_id"] for r in near_dedup.near_dup_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] != c for i, c in expected.items()) == 0


def test_blocks_of_a_group_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 30)
    docs = half_similar(60)
    got = {r["id"]: r["component_id"] for r in near_dedup.near_dup_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_dups(docs).items()}


def test_joining_links_span_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(12, 9).astype(np.uint64)) for _ in range(60)]
    every = np.arange(60)
    links = near_dedup._joining(every, every, sets, every, every)
    label = every.copy()
    for a, b in links:
        assert label[a] != label[b]
        label[label == label[a]] = label[b]
    for x in every:
        for y in every[:x]:
            n = len(np.intersect1d(sets[x], sets[y]))
            assert 100 * n < 75 * (len(sets[x]) + len(sets[y]) - n) or label[x] == label[y]
