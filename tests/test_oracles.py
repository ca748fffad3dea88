"""The driver contract: every registered query against its DuckDB oracle."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sylva.registry import ORACLES, QUERIES
from sylva.sources.parquet import TABLES

from .conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        r = round(v, 6)
        return "nan" if math.isnan(v) else repr(r + 0.0)
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "cluster_id" in df.columns


def test_every_query_has_columns_and_most_have_oracles():
    assert set(oracle_sql()) <= set(queries())
    assert len(ORACLES) >= len(QUERIES) - 3  # of the library's own; the optional queries are not all SQL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    got = _canon(df.columns, df.collect())
    cur = duck.execute(oracle_sql()[name])
    want = _canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
