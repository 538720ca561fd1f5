"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_query_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
