"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from seqloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    names = list(want.columns)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in want.fetchall()), key=repr)


def test_every_query_is_listed():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
