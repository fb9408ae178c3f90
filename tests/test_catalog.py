"""Each query with SQL against DuckDB on the smallest tables, where those are there."""

import os

import pytest

from stowage import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
