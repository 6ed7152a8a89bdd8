"""Every query with SQL gives the rows of its SQL on the smallest tables; the others run."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(n for n in entry.queries() if not n.startswith(("p3", "p4", "p5", "p7", "p8", "p9")))


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(clean(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql:
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert mine == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qa_row", "entity_id", "chunk_row"]


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
