"""Every query that has SQL against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(entry_points.oracle_sql()) & set(entry_points.queries()))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    want = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    assert got == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
