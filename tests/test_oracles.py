"""Every query of the library's own operators against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for m in entry.MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in entry.MODULES for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float) or type(value).__name__ in ("Decimal", "int", "int64", "float64") and not isinstance(value, bool):
        return f"{float(value):.6f}"
    return str(value).removesuffix(" 00:00:00").removesuffix("+00:00")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    frame = QUERIES[name](spark, SF)
    held = con.execute(ORACLES[name])
    names = [d[0] for d in held.description]
    assert sorted(frame.columns) == sorted(names)
    want = sorted(tuple(plain(v) for v in r) for r in held.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).schema


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
