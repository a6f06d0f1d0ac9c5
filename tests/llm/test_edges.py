"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import brute
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.llm import chat, decontamination, exact_dedup, langid, mixing, near_dedup, sharding, substring_dedup, token_counts, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(xs):
    return sorted(xs, key=lambda x: tuple((v is None, str(v)) for v in x))


def test_sharding(odd_docs, no_docs):
    out = sharding.external_shuffle(odd_docs, 4, bucket_bytes=1000)
    assert set(out.columns) == {c for c in odd_docs.columns if c not in ("shard", "SLOT")} | {"shard", "slot"}
    got = out.collect()
    assert ordered((r["doc_id"], r["text"]) for r in got) == ordered(pairs(odd_docs))
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.external_shuffle(odd_docs.repartition(5), 4, bucket_bytes=1000).collect()
    place = lambda rs: ordered((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rs)
    assert place(got) == place(again)
    assert sharding.write_shards(sharding.external_shuffle(no_docs, 4)).count() == 0
    assert {r["shard"] for r in sharding.external_shuffle(odd_docs.limit(2), 24).collect()} <= set(range(24))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_id(spark, odd_docs, no_docs, model):
    got = langid.identify(odd_docs, model).join(odd_docs.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
        assert letters or r["rejected"]
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.fit(odd_docs).labels == ["de", "en"]


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "jumps over the lazy dog. it was a very fine day in the old town. everyone"), (2, None), (3, ""), (4, "only here"), (5, "WORDS ONLY here now"), (None, "quick brown fox jumps over"), (6, "quick brown fox jumps over the"), (6, "a row of eight")],
        "item_id long, text string",
    ).withColumn("id", F.lit(1))
    docs, its = pairs(odd_docs), [(r["item_id"], r["text"]) for r in items.collect()]
    expected = sorted((str(d), str(i), n, s) for (dt, it), (n, s) in brute.contained([((k, d[0]), d[1]) for k, d in enumerate(docs)], [((k, i[0]), i[1]) for k, i in enumerate(its)]).items() for d, i in [(dt[1], it[1])])
    found = decontamination.contained_items(odd_docs, items, block_bytes=60).collect()
    assert sorted((str(r["id"]), str(r["item_id"]), r["item_shingles"], r["shared"]) for r in found) == expected
    clean = decontamination.remove_contaminated(odd_docs, items)
    hit = {r["id"] for r in found}
    assert clean.columns == odd_docs.columns and {d for d, _ in pairs(clean)} == {d for d, _ in docs if d not in hit}
    assert decontamination.contained_items(no_docs, items).count() == 0
    assert decontamination.contained_items(odd_docs, items.limit(0)).count() == 0
    assert decontamination.remove_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_token_counts(odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    expected = ordered((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in pairs(odd_docs))
    assert ordered(map(tuple, token_counts.token_counts(odd_docs, PATH).collect())) == expected
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_near_dedup(odd_docs, no_docs):
    got = near_dedup.near_dup_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert [r["kept"] for r in got if r["id"] == 3] == [False, False] and by[1]["kept"]
    assert by[11]["component_id"] == 10 and not by[11]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] and by[i]["component_id"] == i for i in (4, 5, 6))
    assert all(r["component_id"] is None and r["kept"] for r in got if r["id"] is None)
    sets = {d: len(brute.shingle_set(t)) for d, t in pairs(odd_docs) if d is not None}
    assert all(by[d]["n_shingles"] == n for d, n in sets.items())
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert near_dedup.near_dup_classes(no_docs).count() == 0 and near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_near_dedup_keeps_one_of_repeated_rows(odd_docs):
    twice = odd_docs.where("doc_id in (3, 10)")
    assert sorted(d for d, _ in pairs(near_dedup.drop_near_duplicates(twice))) == [3, 10]


def test_mixing(odd_docs, no_docs):
    d = mixing.plan_mix(odd_docs).decisions().collect()
    assert len(d) == odd_docs.count()
    sizes = {}
    for r in odd_docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.word_list(r["text"]))
    expected = brute.targets(sizes)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]]) for r in d)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in d)
    assert mixing.plan_mix(no_docs).decisions().count() == 0 and mixing.mix(no_docs).count() == 0
    blank = odd_docs.where("doc_id in (4, 5, 6)")
    assert all(r["target"] == 0 and r["size"] == 0 for r in mixing.plan_mix(blank).decisions().collect())
    moved = mixing.plan_mix(odd_docs.repartition(7)).decisions().collect()
    assert ordered(map(tuple, moved)) == ordered(map(tuple, d))


def test_exact_dedup(odd_docs, no_docs):
    got = exact_dedup.exact_dedup([odd_docs]).collect()
    classes = {}
    for d, t in pairs(odd_docs):
        classes.setdefault(brute.fold(t), []).append(d)
    assert sum(r["kept"] for r in got) == len(classes) and len(got) == odd_docs.count()
    largest = {d: max((x for x in ds if x is not None), default=None) for ds in classes.values() for d in ds if d is not None}
    assert all(r["keep_id"] == largest[r["id"]] for r in got if r["id"] is not None)
    assert exact_dedup.exact_dedup([no_docs]).count() == 0


def test_digest_index_goes_on_in_batches(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, buckets=3)
    first.ingest(batch((1, "A"), (2, "b")))
    first.close()
    later = exact_dedup.DigestIndex(spark, path, buckets=3)  # as another session would open it
    later.ingest(batch((3, "a"), (4, "C"), (5, "c")))
    later.ingest(batch())
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in later.report().collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (5, 2, False), 5: (5, 2, True)}
    plan = spark.table(later.table).join(spark.table(later.table).select("digest").hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    later.close()


def test_substring_dedup(odd_docs, no_docs):
    got = {r["id"]: r for r in substring_dedup.dedup_substrings(odd_docs.where("doc_id < 8")).collect()}
    assert set(got) == {2, 3} and got[2]["first_ids"] == [1]
    assert substring_dedup.dedup_substrings(odd_docs).columns == ["id", "text", "removed_bytes", "removed", "first_ids"]
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_takes_repeated_rows_as_one_document(spark, odd_docs):
    rows = odd_docs.where("doc_id = 3")
    assert rows.count() == 2 and substring_dedup.dedup_substrings(rows).count() == 0
    text = rows.first()["text"]
    mixed = spark.createDataFrame([(3, text), (3, text), (3, "Another. " + text), (None, text), (None, text), (None, text + " x")], "doc_id long, text string")
    got = substring_dedup.dedup_substrings(mixed).collect()
    assert sorted((r["id"] is None, r["first_ids"]) for r in got) == [(False, [3]), (True, [3]), (True, [3]), (True, [3])]


def test_chat_folds_edits_and_regenerations(spark):
    events = spark.createDataFrame(
        [
            (1, 1, 3, "delta", None, None, "lo"), (1, 1, 0, "open", "user", 0, None), (1, 1, 1, "delta", None, None, "hel"),
            (1, 2, 0, "open", "assistant", 1, None), (1, 2, 1, "delta", None, None, "bad"), (1, 2, 2, "regenerate", None, None, None),
            (1, 2, 3, "delta", None, None, "go\\od <|im_end|>"), (1, 2, 3, "delta", None, None, "go\\od <|im_end|>"),
            (2, 3, 0, "open", None, None, None), (2, 4, 0, "open", "sys\ntem", 2, None), (2, 4, 1, "delta", None, None, "x"), (2, 4, 9, "edit", None, None, "yz"),
            (None, None, 0, "open", "user", 0, "ignored"), (3, 7, 1, "delta", None, None, "lost"),
        ],
        "conv_id long, message_id long, seq long, kind string, role string, position long, text string",
    ).withColumn("rendered", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.fold_events(events)).collect()}
    twice = "go\\od <|im_end|>" * 2
    assert got == brute.chat([(1, 0, "user", "hello"), (1, 1, "assistant", twice), (2, -1, "", ""), (2, 2, "sys\ntem", "yz"), (None, 0, "user", ""), (3, 0, "", "lost")])
    assert chat.read_back(chat.fold_events(events.limit(0))).count() == 0
    with pytest.raises(Exception, match="no such event"):
        chat.fold_events(events.withColumn("kind", F.lit("odd"))).collect()


def test_chat_turns_with_nulls_and_ties(spark):
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "ä" * 1001), (1, 2, "user", "odd one"), (1, 3, "assistant", "x"), (2, None, "user", "q"), (None, 6, "assistant", ""), (4, 2, "assistant", "y" * 300_000), (5, 1, "user", "same"), (5, 1, "user", "same")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.fold_events(chat.turns_to_events(turns))).collect()}
    assert got == brute.chat([(c, t if t is not None else -1, r, x) for c, t, r, x in map(tuple, turns.collect())])


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<p>x\r\n\r\nWARC/1.0\r\n</p>"), (None, None, None), (2, "http://b/\r\nContent-Length: 5", ""), (2, "http://c", "y" * 300_000), (2, "http://c", "y" * 300_000), (3, "http://ü", "é" * 70_000)],
        "page_id long, url string, html string",
    ).withColumn("record", F.lit(1)).withColumn("segment", F.lit("s"))
    packed = warc.pack(pages, segment_bytes=200_000)
    manifest = warc.manifest(packed)
    files = warc.read_archive(spark, warc.write_archive(packed))
    place = lambda df: sorted(tuple(r) for r in df.select("segment", "offset", "length", "digest").collect())
    assert place(files) == place(manifest)
    assert warc.audit_replica(manifest, files).count() == 0
    bad = files.withColumn("digest", F.when(F.col("length") > 200_000, F.lit("0")).otherwise(F.col("digest")))
    assert sorted(r["status"] for r in warc.audit_replica(manifest, bad, range_bytes=1000, fanout=2).collect()) == ["corrupt", "corrupt"]
    lost = files.where("length > 1000")
    statuses = [r["status"] for r in warc.audit_replica(manifest, lost, range_bytes=1000).collect()]
    assert statuses == ["missing"] * (pages.count() - lost.count())
    assert {r["status"] for r in warc.audit_replica(lost, manifest).collect()} == {"extra"}
    empty = warc.manifest(warc.pack(pages.limit(0)))
    assert empty.count() == 0 and warc.audit_replica(empty, empty).count() == 0
    assert warc.read_archive(spark, warc.write_archive(warc.pack(pages.limit(0)))).count() == 0
    assert warc.audit_replica(manifest, empty).count() == pages.count()


def test_warc_reader_gets_past_a_broken_header():
    data = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Lexgth: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [(a, p) for a, _, p in warc._records(data)] == [(0, None), (38, None), (76, "9")]
    assert list(warc._records(b"")) == []


def test_numerals_and_signs_are_no_letters(spark, sf_docs):
    model = langid.fit(spark.createDataFrame([(d[1], d[2]) for d in sf_docs], "text string, lang string"))
    texts = ["½ ² Ⅷ", "①", "٣ ३", "_ -", "🙂", "́", "ﬁn", "ª", "日本"]
    found = {r["id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert (found[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t)), t
        assert found[i]["lang_pred"] != "und" or (found[i]["score"] == 0 and found[i]["rejected"])


def test_many_labels_are_cut_to_those_of_most_texts(spark, sf_docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 4)
    langs = sorted({d[2] for d in sf_docs if d[2]})
    rows = [(d[1], d[2]) for d in sf_docs] + [(f"some junk text number {i}", f"junk{i}") for i in range(40)]
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string")).labels == langs[:4]


def test_digest_index_after_a_broken_ingest(spark, monkeypatch):
    path = shared_dir(spark, "broken-digests")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    index.ingest(frame([(1, "a"), (2, "A"), (3, "b")]))
    second = frame([(4, "b"), (5, "c"), (6, "c")])

    def broken(*_):
        raise RuntimeError("executor lost")

    for step in ("_append", "after"):
        with monkeypatch.context() as m:
            if step == "_append":  # rows are written, digests are not
                m.setattr(index, "_append", broken)
            else:  # both are written, the batch isn't named as complete
                append = index._append
                m.setattr(index, "_append", lambda new: (append(new), broken()))
            with pytest.raises(RuntimeError):
                index.ingest(second)
    report = lambda i: sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in i.report().collect())
    first = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert report(index) == first
    again = exact_dedup.DigestIndex(spark, path)
    again.ingest(second)
    both = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 3, 2, False), (5, 6, 2, False), (6, 6, 2, True)]
    assert report(again) == both
    index.close()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, id_type="string")
    assert again.buckets == 3


@pytest.mark.parametrize("kind", ["int", "smallint", "date", "string", "double", "decimal(6,2)", "struct<a:int>"])
@pytest.mark.parametrize("words", [12, 13])
def test_contained_items_of_any_id_type(spark, kind, words):
    """Also on both sides of the item size from which MinHash is used: 8 and 9 shingles."""
    text = " ".join(f"w{i}" for i in range(words))
    value = {"date": "date '2024-01-02'", "string": "'x'", "struct<a:int>": "named_struct('a', 7)"}.get(kind, f"CAST(7 AS {kind})")
    items = spark.sql(f"SELECT {value} AS item_id, '{text}' AS text UNION ALL SELECT NULL, 'no such words in any of the texts here at all'")
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "w1 w2 w3 w4 w5 w6"), (3, None)], "doc_id int, text string")
    got = decontamination.contained_items(docs, items).collect()
    assert [(r["id"], r["item_shingles"], r["shared"]) for r in got] == [(1, words - 4, words - 4)]
    assert got[0]["item_id"] == items.first()["item_id"]
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3]
