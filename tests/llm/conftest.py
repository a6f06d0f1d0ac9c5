from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    common = "the quick brown fox jumps over the lazy dog. it was a very fine day in the old town. everyone had come to see the fair and the people. "
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(150_000))
    rows = [
        (1, common + "One more.", "en", "b", 10),
        (2, (common + "One more.").upper(), "en", "b", 10),
        (3, common + "One more.", None, None, None),
        (3, common + "One more.", None, None, None),
        (4, None, "en", "a", None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "de", "a", 4),
        (7, "12 34 !!", "de", "c", 8),
        (8, long_text, "en", "c", len(long_text)),
        (9, "x" * 200_000, "en", "c", 200_000),
        (None, "a text without an id but with words", "en", "a", 35),
        (None, None, None, None, None),
        (10, "four words only here", "en", "a", 20),
        (11, "four words only here", "en", "a", 20),
        (12, "ÀÉ Ünïcode ß words in a row of eight", "de", "b", 30),
    ]
    extra = "id long, row_no long, th long, rep long, key string, row string, h string, bucket string, shard string, SLOT string, size string, copies string, `dotted.name` string, component_id long, keep_id long, slice double"
    values = (7, 7, 7, 7, "k", "r", "h", "b", "s", "t", "z", "c", "d", 7, 7, 0.5)
    return spark.createDataFrame([r + values for r in rows], f"{DOCS}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
