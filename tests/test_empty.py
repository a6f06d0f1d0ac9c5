"""FIXTURES §3 `empty`: every operator returns on empty input (sum 0,
count 0, empty frames); the ones defined to fail on empty input raise a
clear error instead of crashing inside a task."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import agg, histogram, joins, keyed, layout, order, position, rows, sampling, sets
from tessera.plans import wordcount


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "k string, v long")


def test_empty_inputs_return(spark, empty):
    assert agg.sum_value(empty, "v").first()[0] == 0
    assert agg.count_rows(empty).first()[0] == 0
    assert tuple(agg.aggregate_sum_count(empty, "v").first()) == (0, 0)
    assert agg.stats(empty, "v").first()["count"] == 0
    assert agg.count_by_value(empty).count() == 0
    assert keyed.reduce_by_key(empty).count() == 0
    assert keyed.group_by_key(empty, chunk_rows=10).count() == 0
    assert keyed.combine_by_key(empty, str, lambda a, v: a + str(v), lambda a, b: a + b).count() == 0
    assert joins.join(empty, empty, "k").count() == 0
    assert joins.join(empty, empty, "k", "full").count() == 0
    assert joins.cogroup([empty, empty], chunk_rows=10).count() == 0
    assert joins.subtract_by_key(empty, empty, "k").count() == 0
    assert sets.subtract(empty, empty).count() == 0
    assert sets.intersection(empty, empty).count() == 0
    assert order.sort_by_key(empty, "k").count() == 0
    assert order.ranked(empty, ["k"]).count() == 0
    assert order.top(empty, 3, ["v"]).count() == 0
    assert order.is_empty(empty).first()[0] is True
    assert position.zip_with_index(empty).count() == 0
    assert position.zip_with_unique_id(empty).count() == 0
    assert sampling.sample_hash(empty, 0.5, ["k"]).count() == 0
    assert sampling.take_sample(empty, 5, ["k"]).count() == 0
    assert sampling.take_sample_with_replacement(empty, 5).count() == 0
    assert all(not r["rows"] for r in layout.glom(empty).collect())
    assert rows.pipe(empty.select(F.col("k").alias("value")), "cat").count() == 0
    texts = spark.createDataFrame([], "text string")
    assert wordcount.word_count_tokens(texts).first()[0] == 0
    assert wordcount.word_frequencies(texts).count() == 0


def test_empty_inputs_that_must_fail(spark, empty):
    with pytest.raises(ValueError):
        histogram.histogram_even(empty, "v", 4)
    with pytest.raises(ValueError):
        agg.reduce(empty, "v", "max", strict=True)


def test_nan_sorts_last_and_equals_itself(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in order.sort_by_key(df, "x").collect()]
    assert got[0] is None and got[1] == 1.0 and all(v != v for v in got[2:])
    assert agg.count_by_value(df).where(F.isnan("x")).first()["count"] == 2
