"""Queries that have SQL, against DuckDB on the smallest tables."""

import os

import pytest

from stowage.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in df.select(*cols).collect()) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
