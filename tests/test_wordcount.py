"""Word count: both metrics, text-file line rules, invariance to partitioning."""

from pyspark.sql import functions as F

from tessera.functions.exprs import line_count, lines_of, space_run_count, split_token_count, tokens_of
from tessera.plans import wordcount

EDGE = [" a  b ", "", "a", "a\tb"]


def _texts(spark, values, n=1):
    return spark.createDataFrame([(v,) for v in values], "text string").repartition(n)


def test_edge_lines_split_tokens_and_runs(spark):
    # each value is one line (a one-line text); "" is a text with no line at all
    df = spark.createDataFrame([(v,) for v in EDGE], "text string")
    got = df.select("text", split_token_count("text").alias("t"), space_run_count("text").alias("r")).collect()
    m = {r["text"]: (r["t"], r["r"]) for r in got}
    assert m[" a  b "] == (5, 2)
    assert m["a"] == (1, 1)
    assert m["a\tb"] == (1, 1)  # a tab does not separate
    assert m[""] == (0, 0)  # an empty file has no line


def test_line_semantics(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("a\rb\n\nc",), ("x",)], "text string")
    got = {r["text"]: (r["n"], list(r["lines"])) for r in
           df.select("text", line_count("text").alias("n"), lines_of("text").alias("lines")).collect()}
    assert got["a\nb\n"] == (2, ["a", "b"])
    assert got["a\r\nb"] == (2, ["a", "b"])
    assert got["a\rb\n\nc"] == (4, ["a", "b", "", "c"])
    assert got["x"] == (1, ["x"])


def test_tokens_match_python_split(spark):
    texts = ["a b\nc  d\n", " x\r\ny ", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [list(r[0]) for r in df.select(tokens_of("text")).collect()]
    want = []
    for t in texts:
        lines = t.replace("\r\n", "\n").split("\n")
        if t.endswith("\n"):
            lines = lines[:-1]
        want.append([w for line in lines for w in line.split(" ")])
    assert got == want


def test_totals_and_frequencies_independent_of_partitions(spark):
    texts = ["the cat  sat\non the mat", " lead", "trail ", "x\n\ny", "the the the"] * 7
    base = None
    for n in (1, 3, 8):
        df = _texts(spark, texts, n)
        t = wordcount.word_count_tokens(df).first()[0]
        r = wordcount.word_count_runs(df).first()[0]
        f = sorted(tuple(x) for x in wordcount.word_frequencies(df).collect())
        if base is None:
            base = (t, r, f)
        assert (t, r, f) == base
    lines = [ln for t in texts for ln in t.split("\n")]
    assert base[0] == sum(len(ln.split(" ")) for ln in lines)
    assert base[1] == sum(len([w for w in ln.split(" ") if w]) for ln in lines)
    freq = {}
    for ln in lines:
        for w in ln.split(" "):
            freq[w] = freq.get(w, 0) + 1
    assert dict(base[2]) == freq


def test_empty_input(spark):
    df = spark.createDataFrame([], "text string")
    assert wordcount.word_count_tokens(df).first()[0] == 0
    assert wordcount.word_count_runs(df).first()[0] == 0
    assert wordcount.word_frequencies(df).count() == 0


def test_frequencies_plan_has_partial_aggregate(spark):
    df = _texts(spark, ["a b a"], 2)
    plan = wordcount.word_frequencies(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert F is not None
