"""Items on both sides of the number of shingles from which minhashes are used."""

from __future__ import annotations

import random

import brute

from tessera.llm import decontamination as dc


def test_items_at_the_border_are_found_alike(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    items, docs = [], []
    for shingles in (dc.TINY - 1, dc.TINY, dc.TINY + 1, dc.TINY + 2):
        for k in range(6):
            words = [word() for _ in range(shingles + 4)]
            items.append((f"{shingles}-{k}", " ".join(words)))
            near = words[: -1 - k % 3]  # one to three shingles less
            for held in (words, near):
                docs.append((len(docs), " ".join([word() for _ in range(400)] + held + [word() for _ in range(400)])))
    expected = brute.contained(docs, items)
    got = dc.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(r["id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in got} == expected
    assert {i.split("-")[0] for _, i in expected} == {str(dc.TINY + d) for d in (-1, 0, 1, 2)}
