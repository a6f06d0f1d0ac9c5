"""Repeated runs of 50 words, against brute force."""

from __future__ import annotations

import random
import re

import brute
import numpy as np

from tessera.llm import substring_dedup as sd


def corpus() -> list[tuple[int, str]]:
    """Passages of 50 words and more without three whole sentences, inside texts of other words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passages = [[word() for _ in range(n)] for n in (50, 53, 80, 130)]
    passages[1][25] += "."  # two sentences
    passages[2][::9] = [w + ".”" for w in passages[2][::9]]
    docs = []
    for i in range(40):
        p = passages[i % 4]
        docs.append((i, " ".join([word() for _ in range(rng.randrange(70))] + p + [word() for _ in range(rng.randrange(70))])))
    return docs + [(40, " ".join(passages[0][:49])), (41, " ".join(passages[3] * 2))]


def test_every_repeated_run_of_fifty_words_goes(spark):
    docs = corpus()
    seen, gone = set(), {}
    for doc, text in docs:
        w = brute.word_list(text)
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if run in seen:
                gone.setdefault(doc, set()).update(range(i, i + 50))
            seen.add(run)
    got = {r["id"]: r["text"] for r in sd.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(gone) == 37 and 40 not in got
    for doc, words in gone.items():
        w = brute.word_list(dict(docs)[doc])
        assert not set(brute.word_list(got[doc])) & {w[i] for i in words}


def test_equal_runs_hold_an_equal_anchor():
    rng = np.random.default_rng(4)
    run = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for _ in range(50):
        x, y = (np.r_[rng.integers(0, 2**63, k, dtype=np.uint64), run, rng.integers(0, 2**63, 30, dtype=np.uint64)] for k in (17, 42))
        (p, g), (q, h) = sd.anchors(x), sd.anchors(y)
        inside = lambda at, v, k: {(int(i) - k, int(u)) for i, u in zip(at, v, strict=True) if k <= i <= k + 30}
        assert inside(p, g, 17) & inside(q, h, 42)


def test_sentences_end_at_other_full_stops_and_before_quotes():
    text = "一 二。 he said “no.” then (yes!) and (no) ह।".encode()
    starts, stops, _ = sd.S.words(text)
    assert sd._ends(text, stops).tolist() == [False, True, False, False, True, False, True, False, False, True]


def test_blocks_give_what_runs_of_words_give(spark):
    """Overlapping passages, other white space, repeats inside a text, repeated rows and ids, and no id."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(700)]
    docs = []
    for i in range(60):
        parts = [pool[x : x + rng.randrange(30, 150)] for x in rng.choices(range(600), k=2)]
        if i % 5 == 0:
            parts[0] = parts[0][:20] + [f"own{i}"] + parts[0][20:]
        gap = "  " if i % 7 == 0 else " "
        docs.append((i // 2 if i > 50 else i if i % 11 else None, gap.join([f"x{i}", *parts[0], f"y{i}", *parts[1]])))
    docs += docs[:6]
    firsts, runs = {}, {}
    for doc, text in set(docs):
        at, w = [m.span() for m in re.finditer(r"\S+", text)], text.split()
        for k in range(len(w) - 49):
            place = (doc is None, 0 if doc is None else doc, at[k][0])
            runs.setdefault((doc, text), []).append((tuple(w[k : k + 50]), place, set(range(at[k][0], at[k + 49][1]))))
            if doc is not None:
                firsts[tuple(w[k : k + 50])] = min(place, firsts.get(tuple(w[k : k + 50]), place))
    gone = {}
    for (doc, text), found in runs.items():
        if doc is not None:
            for run, place, cover in found:
                if firsts[run] != place:
                    bytes_, ids = gone.setdefault((doc, text), (set(), set()))
                    bytes_ |= cover
                    ids.add(firsts[run][1])
    got = sd.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = {doc: [t for d, t in set(docs) if d == doc] for doc, _ in docs}
    want = sorted((doc, "".join(c for i, c in enumerate(text) if i not in cut), len(cut), sorted(ids)) for (doc, text), (cut, ids) in gone.items() for _ in range(docs.count((doc, text))))
    assert len(want) > 40 and any(len(t) > 1 for t in texts.values())
    assert sorted((r["id"], r["text"], r["removed_bytes"], [x["id"] if hasattr(x, "asDict") else x for x in r["first_ids"]]) for r in got if r["id"] is not None) == want


def test_repeated_runs_are_not_a_row_each(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    gone = sd.repeated_spans(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert 0 < len(gone) < 400 and {r["ord"] for r in gone} == {2} == {r["ord"] + 1 for r in (g["first"] for g in gone)}
    assert set().union(*(range(r["start"], r["stop"]) for r in gone)) == set(range(len(text)))


def test_only_results_stay_in_the_shared_folder(spark):
    from tessera import session

    before = set(session._MADE)
    gone = sd.repeated_spans(spark.createDataFrame(corpus(), "doc_id long, text string"))
    left = [p.rpartition("/")[2] for p in session._MADE - before]
    assert sorted(p.rpartition("-")[0] for p in left) == ["tessera-repeated-runs", "tessera-repeated-spans"]
    assert gone.count() > 0


def odd_texts() -> list[bytes | None]:
    """Short and long texts with other full stops, white space and line ends, empty ones, and one beyond a block."""
    rng = random.Random(9)
    pool = ["a", "B", "c.", 'd."', "“e.”", "f,", "g;", "ह।", "二。", "h!", "(i?)", '"', "’", "\n"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 30, 49, 50, 51, 200, 400]))).strip(rng.choice(["", " "])) for _ in range(300)]
    return [*(t.encode() for t in texts), None, b"", b" \n", b"one word. " * 120_000, *(t.encode() for t in texts[:40])]


def test_many_short_texts_are_cut_at_once(monkeypatch):
    calls, cut = [], sd.S._words
    monkeypatch.setattr(sd.S, "_words", lambda data: calls.append(len(data)) or cut(data))
    texts = [b"some words of a short text"] * 5000
    assert [x[:2] for x in sd.S.located(texts)] == [(0, 5000)] and len(calls) == 1


def test_a_block_of_texts_gives_what_each_text_gives():
    texts = odd_texts()
    got = {"anchors": {}, "spans": {}, "blocks": {}, "runs": {}}

    def add(kind, of, *values):
        for i, *row in zip(*(x.tolist() for x in (of, *values)), strict=True):
            got[kind].setdefault(i, []).append(tuple(row))

    def cut(first, begins, starts, stops, hashes, offsets, data):
        text = lambda word: np.searchsorted(offsets, word, "right") - 1
        of, at, value = sd._anchors(hashes, offsets)
        add("anchors", of + first, at, value)
        a, b, *h = sd._spans(data, starts, stops, hashes, offsets, sd.SENTENCES, sd.WORDS)
        add("spans", text(a) + first, starts[a] - begins[text(a)], stops[b - 1] - begins[text(a)], *h)
        (a, start, stop, *rest), _ = sd._blocks(starts, stops, hashes, offsets, near=(at + offsets[of])[::2])
        add("blocks", text(a) + first, start - begins[text(a)], stop - begins[text(a)], *rest)
        (a, *_), (own, start, stop, *rest) = sd._blocks(starts, stops, hashes, offsets, begins=start[::2])
        of = text(a)[own]
        add("runs", of + first, start - begins[of], stop - begins[of], *rest)

    blocks = list(sd.S.located(texts))
    assert len(blocks) == 3
    for first, _, data, begins, *words, offsets in blocks:
        cut(first, begins, *words, offsets, data)
    together, got = got, {kind: {} for kind in got}
    for i, t in enumerate(texts):
        starts, stops, hashes = sd.S.words(t or b"")
        start, stop, _, *h = sd.spans(t or b"", runs=False)
        add("spans", np.full(len(start), i), start, stop, *h)
        at, value = sd.anchors(hashes)
        add("anchors", np.full(len(at), i), at, value)
    assert together["spans"] == got["spans"] and together["anchors"] == got["anchors"]
    assert len(together["blocks"]) > 50 and len(together["runs"]) > 50
    for i, rows in together["blocks"].items():
        starts, stops, hashes = sd.S.words(texts[i])
        alone = {row[1:] for row in zip(*(x.tolist() for x in sd._blocks(starts, stops, hashes, np.array([0, len(starts)]), near=np.arange(len(starts)))[0]), strict=True)}
        assert set(rows) <= alone
    for i, rows in together["runs"].items():
        start, stop, n, *h = sd.spans(texts[i])
        runs = {(int(x), int(y), int(u), int(v)) for x, y, k, u, v in zip(start, stop, n, *h, strict=True) if k == sd.RUN}
        assert set(rows) <= runs
