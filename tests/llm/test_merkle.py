"""The manifest against trees built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import merkle, queries


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, for each leaf, the siblings before and after it, level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, place in enumerate(at):
            run = runs[place // 16]
            proofs[leaf].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[leaf] = place // 16
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], proofs


def build(records: list[tuple]) -> list[tuple]:
    """(group, order, digest) rows -> sorted (group, order, digest, rank, subroot, root, steps)."""
    by = defaultdict(list)
    for g, o, d in records:
        by[g].append((o is not None, o or 0, d))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([d for *_, d in sorted(by[g])]) for g in groups}
    root, crown = tree([trees[g][0] for g in groups])
    out = []
    for g, up in zip(groups, crown, strict=True):
        for rank, ((some, o, d), proof) in enumerate(zip(sorted(by[g]), trees[g][1], strict=True)):
            out.append((g, o if some else None, d, rank, trees[g][0], root, proof + up))
    return sorted(out, key=str)


def rows(df):
    got = df.select("g", "o", "d", "merkle_rank", "subroot", "root", "steps").collect()
    return sorted(((*r[:6], [tuple(s) for s in r["steps"]]) for r in got), key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 256], [257, 2], [1] * 300, [4100, 3]])
def test_trees_of_any_height(spark, sizes):
    records = [(f"s{i}" if i else None, n, h(f"{i} {n}")) for i, size in enumerate(sizes) for n in range(size)]
    random.Random(1).shuffle(records)
    df = spark.createDataFrame(records, "g string, o long, d string").repartition(5)
    assert rows(merkle.manifest(df, "g", ["o"], "d")) == build(records)


def test_odd_records(spark):
    records = [(None, None, h("a")), (None, 1, h("b")), ("", 1, h("c")), ("é", 5, h("d")), ("z", 5, h("e")), ("é", 5, h("d")), ("é", None, h("f")), ("é", 5, h("0"))]
    df = spark.createDataFrame(records, "g string, o long, d string")
    extra = df.select("*", *(F.lit(7).alias(c) for c in ("lo", "tree", "size", "kids", "Steps", "place", "group", "a.b", "c0", "digest")))
    out = merkle.manifest(extra, "g", ["o"], "d")
    assert rows(out) == build(records)
    assert {"lo", "tree", "size", "kids", "place", "group", "a.b", "c0", "digest"} <= set(out.columns)
    assert merkle.manifest(df.where("false"), "g", ["o"], "d").count() == 0


def test_record_digests(spark, odd_docs):
    names = ("doc_id", "source", "text")
    got = odd_docs.select(*names, merkle.record_digest([F.col(c) for c in names]).alias("d")).collect()
    for r in got:
        said = "".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in names)
        assert r["d"] == h(said)


def test_a_changed_record_is_found_out(spark):
    df = spark.range(600).select(F.lit("s").alias("g"), F.col("id").alias("o"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    proved = merkle.manifest(df, "g", ["o"], "d").withColumn("now", F.when(F.col("o") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("d")))
    checked = proved.select("o", (merkle.folded(F.col("now"), F.col("steps")) == F.col("root")).alias("same"))
    assert {r["o"] for r in checked.where("not same").collect()} == set(range(0, 600, 7))


def test_op12_matches_plain_trees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()

    def leaf(r, text):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    records = build([(r["source"], r["doc_id"], leaf(r, r["text"])) for r in docs])
    text = {r["doc_id"]: r for r in docs}
    expected = {}
    for _, doc, d, _, subroot, root, steps in records:
        at = d
        if zlib.crc32(str(doc).encode()) % 5 == 0 and text[doc]["text"] is not None:
            at = leaf(text[doc], brute.fold(text[doc]["text"]))
        for left, right in steps:
            at = h(left + at + right)
        expected[doc] = (d, subroot, root, h("".join(a + b for a, b in steps)), at, at == root)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_merkle_manifest(spark, SF).collect()}
    assert got == expected and {v[-1] for v in expected.values()} == {True, False}
