"""Registered queries against their SQL on DuckDB, over a small derived copy of the tables."""

import glob
import os

import duckdb
import pytest

from duonet.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    cur = con.execute(catalog.SQL[name])
    other = cur.fetchall()
    assert norm(df.columns, [tuple(r) for r in rows]) == norm([c[0] for c in cur.description], other)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
