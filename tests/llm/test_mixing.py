"""The mix against a queue in plain Python, and rows that repeat."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def queue(spark, docs: list[tuple], seed: int = 7, share: float = 1.5, epochs: int = 2) -> list[tuple]:
    """(source, id, epoch) of the copies taken: all copies in one list, sorted by finish time."""
    rows, number = [], Counter()
    for i, text, source in docs:
        rows.append((i, text, source, number[i, text, source], len(brute.word_list(text))))
        number[i, text, source] += 1
    sizes = Counter()
    for _, _, source, _, n in rows:
        sizes[source] += n
    target = brute.targets(sizes)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, id long, text string, source string, no long, size long")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    places = frame.select("k", *[F.xxhash64(F.lit(seed), F.lit(e), "id", th, "no").alias(f"e{e}") for e in range(epochs)]).collect()
    queues = defaultdict(list)
    for p in places:
        i, _, source, _, n = rows[p["k"]]
        queues[source] += [(e, p[f"e{e}"], i, n) for e in range(epochs)]
    copies = []
    for source, q in queues.items():
        done = 0
        for e, place, i, n in sorted(q):
            done += n
            if target[source]:
                copies.append((done / target[source], source is None, source or "", place, i, e, source, n))
    taken, used, budget = [], 0, share * sum(sizes.values())
    for c in sorted(copies):
        used += c[-1]
        if used > budget:
            break
        taken.append((c[6], c[4], c[5]))
    return taken


def corpus() -> list[tuple]:
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i * 37 % 90)), ("a", "b", "c", None)[i % 7 % 4]) for i in range(300)]
    return docs + [(1000, "the same " * 50, "b")] * 40


@pytest.mark.parametrize("parts", [1, 5])
def test_mix_is_that_of_a_plain_queue(spark, parts):
    docs = corpus()
    plan = mixing.plan_mix(spark.createDataFrame(docs, SCHEMA).repartition(parts))
    got = plan.schedule.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(len(got)))
    assert [(r["source"], r["id"], r["epoch"]) for r in got] == queue(spark, docs)
    taken = Counter(r["id"] for r in got)
    counts = Counter()
    for d in plan.decisions().collect():
        counts[d["id"]] += d["copies"]
    assert +counts == taken
    mixed = mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(parts))
    assert Counter(r["doc_id"] for r in mixed.collect()) == taken


def test_repeated_rows_meet_the_target(spark):
    docs = [(1, "word " * 50, "a")] * 60 + [(100 + i, "other " * 50, "b") for i in range(41)]
    d = mixing.plan_mix(spark.createDataFrame(docs, SCHEMA).repartition(4)).decisions().collect()
    taken, target = Counter(), {}
    for r in d:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 * 50 for s in target)
    assert len(d) == len(docs) and max(r["copies"] for r in d) <= 2
