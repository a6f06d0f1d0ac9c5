from __future__ import annotations

import brute
import corpus_pipeline
from conftest import SF

from tessera.llm.queries import language_model
from tessera.llm import langid


def test_stages_against_brute_force(spark, sf_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        after = [r["doc_id"] for r in out.collect()]
        if name == "language_id":
            rejected = {r["id"] for r in langid.identify(docs, language_model(docs)).where("rejected").collect()}
            assert sorted(after) == sorted(i for i, _ in before if i not in rejected)
        elif name == "near_dedup":
            assert sorted(after) == sorted(i for i, (_, c) in brute.near_dups(before).items() if i == c)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = {d for d, _ in brute.contained(before, items)}
            assert hit and sorted(after) == sorted(i for i, _ in before if i not in hit)
        elif name == "mixing":
            assert set(after) <= {i for i, _ in before} and max(after.count(i) for i in after) <= 2
        else:
            assert sorted(after) == sorted(i for i, _ in before) and {"shard", "slot"} <= set(out.columns)
        if name != "sharding":
            assert out.columns == columns
        path_rows = out.collect()
        docs = spark.createDataFrame(path_rows, out.schema)


def test_every_stage_takes_odd_and_empty_tables(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() >= 0
        assert stage(spark, no_docs, SF).count() == 0


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
