from __future__ import annotations

import random

from tessera.llm.components import components


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    ring = [(i, 900 + (i + 1 - 900) % 20) for i in range(900, 920)]
    edges = [*chain, *star, *ring, *chain[:5], (7, 7)]
    names = list({x for e in edges for x in e})
    new = dict(zip(names, rng.sample(range(10_000), len(names)), strict=True))
    got = dict(tuple(r) for r in components(spark.createDataFrame([(new[a], new[b]) for a, b in edges], "a long, b long")).collect())
    for group in (range(100, 161), range(500, 560), range(900, 920)):
        assert {got[new[i]] for i in group} == {min(new[i] for i in group)}
    assert new[7] not in got or got[new[7]] == new[7]


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
