"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    rel = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
