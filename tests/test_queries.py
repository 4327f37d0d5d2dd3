"""Every registered query against its DuckDB twin on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"])
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
