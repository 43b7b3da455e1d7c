"""Every query with a SQL twin gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from steadyrun.sources.tables import TABLES
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def order(row):
    return tuple((v is None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=order)
    assert sorted(names) == cols
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))][:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 32 and "run_level_pass_rate" in df.columns
