"""Queries over the smallest tables against the same results in SQL (DuckDB)."""

import glob
import os

import pytest

import __spark_entry__ as entry
from eventlens.queries.registry import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CHECKED = sorted(QUERIES)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = [[round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order] for r in rows]
    return sorted(map(repr, shown))


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    expected = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, expected.fetchall())
