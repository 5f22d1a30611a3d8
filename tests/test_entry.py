"""Driver contract: entry runs; every query has the same columns and values as its oracle (sf0.001)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from log_tables import SF_SMALL


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["normalized_query", "count"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(E._core_sql()) == set(E._QUERIES)


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 12)) if not math.isnan(v) else "nan"
    return "" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    s_rows = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    d_idx = [rel.columns.index(c) for c in order]
    d_rows = sorted(tuple(_norm(r[i]) for i in d_idx) for r in rel.fetchall())
    assert s_rows == d_rows
    assert s_rows, "an empty result checks nothing"
