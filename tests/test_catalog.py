"""Every registered query against its DuckDB oracle at sf0.001 (the driver
checks sf0.01 the same way), plus the entry point's smoke contract."""

import math

import duckdb
import pytest

import __spark_entry__ as ent
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
KEYS = sorted(ent.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and math.isnan(v):
                v = "NaN"
            t.append(v if not hasattr(v, "as_tuple") else float(v))
        out.append(tuple(t))
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return [cols[i] for i in order], out


def test_entry(spark):
    df = ent.entry(spark)
    assert df.columns == ["word", "n"]
    assert df.count() > 0


def test_every_query_has_a_builder_and_most_an_oracle():
    orc = ent.oracle_sql()
    assert set(orc) <= set(KEYS)
    assert len(KEYS) >= 100


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = ent.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    orc = ent.oracle_sql().get(key)
    if orc is None:
        assert srows, f"{key} returned nothing"
        return
    cur = con.execute(orc)
    ocols = [d[0] for d in cur.description]
    sc, sr = _canon(df.columns, srows)
    oc, orr = _canon(ocols, cur.fetchall())
    assert sc == oc
    assert sr == orr
