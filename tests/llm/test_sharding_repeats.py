"""Sharding a table of which a third is one record."""

from __future__ import annotations

from collections import Counter

from tessera.llm import sharding

SCHEMA = "doc_id long, text string"


def test_a_record_repeated_beyond_a_bucket_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_COPIES", 64)
    monkeypatch.setattr(sharding, "GROUP_BUCKETS", 4)
    docs = [(i, f"text number {i}") for i in range(800)] + [(-1, "always the same")] * 400 + [(None, None)] * 3
    place = []
    for parts in (3, 7):
        out = sharding.external_shuffle(spark.createDataFrame(docs, SCHEMA).repartition(parts), 12, bucket_bytes=4000).collect()
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(docs)
        assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(12) for k in range((1203 * (s + 1) + 11) // 12 - (1203 * s + 11) // 12)]
        place.append(sorted((r["shard"], r["slot"], r["doc_id"] or 0, r["text"] or "") for r in out))
        same = Counter(r["shard"] for r in out if r["doc_id"] == -1)
        assert len(same) == 12 and max(same.values()) < 3 * min(same.values())
    assert place[0] == place[1]


def test_a_very_long_record_is_whole(spark):
    docs = [(1, "x" * 100_000), (2, ""), (3, None)]
    out = sharding.external_shuffle(spark.createDataFrame(docs, SCHEMA), 2, bucket_bytes=1000).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out)) == docs
