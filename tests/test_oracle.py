"""Every catalogue query against its DuckDB oracle on the smallest star (sf0.001)."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E
from carelens.plans.registry import NO_ORACLE, ORACLE, QUERIES
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert QUERIES.items() <= E.queries().items() and ORACLE.items() <= E.oracle_sql().items()
    assert set(QUERIES) - set(ORACLE) == NO_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == exp


def test_freshness_is_iso_seconds(spark):
    v = QUERIES["q_freshness"](spark, SF_SMALL).collect()
    assert len(v) == 1 and len(v[0]["updated_at"]) == 25 and v[0]["updated_at"][10] == "T"


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["discharge_count"] > 0
