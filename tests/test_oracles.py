"""Every registered query against its DuckDB twin over the driver's small tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from sparkobs.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def computed(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def results(request, spark):
    """All selected queries, a few at a time: each is short and mostly planning."""
    names = [x.callspec.params["name"] for x in request.session.items if x.module is request.module]
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(computed, spark, name) for name in names}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, db, name):
    columns, got = results[name].result()
    if name not in ORACLE_SQL:
        return
    res = db.sql(ORACLE_SQL[name])
    assert sorted(res.columns) == columns
    at = [res.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert len(got) == len(want)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
