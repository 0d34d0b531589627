"""Every query with SQL against DuckDB on the same tables; test_whole_tables.py has those without."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from prismflow import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def bag(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    rel = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    at = [rel.columns.index(c) for c in cols]
    want = bag(tuple(r[i] for i in at) for r in rel.fetchall())
    assert bag(tuple(r) for r in got.select(*cols).collect()) == want and want
