"""Queries with a SQL twin, value by value; all others at least run whole."""

import os

import duckdb
import pytest

from sparkobs.llm import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    res = con.sql(queries.ORACLE_SQL[name])
    at = [res.columns.index(c) for c in columns]
    assert got == sorted(tuple(r[i] for i in at) for r in res.fetchall())
