"""Ranked search against all scores in plain Python, bounds against their documents."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from conftest import SF

from tessera.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs: list[tuple], items: list[tuple], k: int) -> dict:
    """item -> [(rank, doc, score)], all documents scored."""
    held = [(i, Counter(TERM.findall(brute.fold(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(brute.fold(text))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        best = sorted(scores)[:k]
        if best:
            out[item] = [(rank, i, -s) for rank, (s, _, _, i) in enumerate(best, 1)]
    return out


def by_item(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r[0]].append((r["rank"], r[2], r["score"]))
    return dict(out)


def test_terms():
    text = "Don't_STOP Ünï 1,000\t日本\x7fx~é\x00Z"
    assert [t.decode() for t in lexical_search.terms(text.encode())] == TERM.findall(brute.fold(text))


def test_op11_matches_all_scores(spark, sf_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = ranked([(d[0], d[1]) for d in sf_docs], items, 50)
    assert by_item(queries.op11_lexical_search(spark, SF).collect()) == expected


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_merkle_manifest"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLE[name])
    at = [c[0] for c in expected.description]
    assert sorted(at) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*at).collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("sizes", [(48, 2048, 4096), (2, 7, 5)])
def test_odd_tables_ties_and_small_blocks(spark, odd_docs, no_docs, monkeypatch, sizes):
    leaf, subtree, block = sizes
    monkeypatch.setattr(lexical_search, "SUBTREE", subtree)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    copies = [(100 + i, "The quick, quick fox!") for i in range(40)] + [(i, f"word {i % 5} fox") for i in range(200, 260)]
    frame = spark.createDataFrame(copies, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    items = [(1, "quick fox"), (2, "Fox fox WORD 3"), (3, None), (4, ""), (None, "the old town"), (6, "nowhere else"), (7, "words Ünïcode x")]
    bench = spark.createDataFrame([(*r, "s", 1) for r in items], "item_id long, text string, score string, `rank.x` int")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    for k in (1, 3, 50):
        assert by_item(lexical_search.top_documents(frame, bench, k).collect()) == ranked(docs, [(i, t or "") for i, t in items], k)
    assert lexical_search.top_documents(no_docs, bench).count() == 0
    assert lexical_search.top_documents(frame, bench.where("false")).count() == 0
    assert lexical_search.top_documents(frame, bench.where("item_id in (3, 4)")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_every_row_is_in_one_leaf_and_inside_its_balls(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 10**6, (300, 20)) * (rng.random((300, 20)) < 0.2) * rng.integers(1, 15_000, 20)[None, :].astype(float)
    x[50:150] = x[0]
    tree = lexical_search.Balls(x, leaf=8)
    assert sorted(np.concatenate([r for r in tree.rows if r is not None])) == list(range(300))

    def below(node):
        return tree.rows[node] if tree.rows[node] is not None else np.concatenate([below(k) for k in tree.kids[node]])

    for node in range(len(tree.rows)):
        far = np.sqrt(((x[below(node)] - tree.centre[node]) ** 2).sum(axis=1))
        assert (far <= tree.radius[node] * (1 + 1e-12)).all()
