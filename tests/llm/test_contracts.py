"""Registered queries over a whole small table against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import brute
import duckdb
import public_tokenizers
import pytest
from conftest import SF

from tessera.llm import queries


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1_shards_hold_every_document_once(spark, sf_docs):
    got = rows(spark, "op1_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in sf_docs)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {d[0]: d[1] for d in sf_docs}
    assert all(r["text_crc32"] == brute.crc(text[r["doc_id"]]) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 for r in got)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_op2_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    found = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    j = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert j[0] > 0.98 and 0 <= j[1] <= j[2] <= 1


def test_op3_reads_back_what_was_said(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    expected = brute.chat([*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(spark, "op3_chat_format")}
    assert got == expected


def test_op4_matches_exact_containment(spark, sf_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute.contained([(d[0], d[1]) for d in sf_docs], items)
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in rows(spark, "op4_decontamination")}
    assert expected and got == expected


def test_op5_counts_as_the_library(spark, sf_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {d[0]: (len((d[1] or "").encode()), len(t.encode(d[1] or "", add_special_tokens=False).ids)) for d in sf_docs}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows(spark, "op5_token_counts")}
    assert got == expected


def test_op6_matches_all_pairs(spark, sf_docs):
    expected = brute.near_dups([(d[0], d[1]) for d in sf_docs])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op6_near_dedup")}
    assert got == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows(spark, "op6_near_dedup"))


def test_op7_meets_targets(spark, sf_docs):
    got = rows(spark, "op7_mixing")
    source, size = {d[0]: d[3] for d in sf_docs}, {d[0]: len(brute.word_list(d[1])) for d in sf_docs}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    expected = brute.targets(sizes)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(expected[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    largest = {s: max(size[i] for i in size if source[i] == s) for s in sizes}
    assert all(abs(taken[s] - expected[s]) <= 2 * largest[s] + 1e-6 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op7_mixing")))


def test_op8_finds_exactly_the_damaged_records(spark):
    from pyspark.sql import functions as F

    from tessera.llm import warc

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    record = warc.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    text = {r[0]: r[1] for r in pages.select("page_id", record).collect()}
    got = rows(spark, "op8_warc_audit")
    assert sorted(r["page_id"] for r in got) == sorted(text)
    damaged = {i for i, t in text.items() if len(t.encode()) % 101 == 7 and "</body>" in t}
    assert {r["page_id"] for r in got if r["status"] != "intact"} == damaged
    assert all(r["digest"] == hashlib.sha256(text[r["page_id"]].encode()).hexdigest() for r in got)
    ends = sorted((r["segment"], r["offset"], r["length"]) for r in got)
    assert all(b[1] == a[1] + a[2] + 4 for a, b in zip(ends, ends[1:], strict=False) if a[0] == b[0])


def test_op9_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(queries.ORACLE["op9_exact_dedup"]).fetchall()
    got = queries.op9_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_op10_leaves_no_repeated_span(spark, sf_docs):
    from tessera.llm import substring_dedup as sd

    firsts, later = {}, defaultdict(set)
    for doc, text, *_ in sorted(sf_docs):
        for start, stop, n, hi, lo in zip(*sd.spans((text or "").encode()), strict=True):
            words = tuple(brute.word_list((text or "").encode()[start:stop].decode()))
            assert len(words) == n >= sd.WORDS
            if words in firsts:
                later[doc].add((int(start), int(stop)))
            firsts.setdefault(words, doc)
    got = {r["doc_id"]: r for r in rows(spark, "op10_substring_dedup")}
    assert set(got) == set(later)
    for doc, cuts in later.items():
        text = next(d[1] for d in sf_docs if d[0] == doc).encode()
        gone = set().union(*(range(a, b) for a, b in cuts))
        assert got[doc]["text"] == bytes(c for i, c in enumerate(text) if i not in gone).decode()
        assert got[doc]["removed_bytes"] == len(gone)
