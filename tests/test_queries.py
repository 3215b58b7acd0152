"""Every query that has SQL gives DuckDB's rows over the smallest test tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == sorted([plain(r[i]) for i in order] for r in found.fetchall())
