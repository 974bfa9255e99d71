"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from phenogrid.llm import entries


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    df = entries.QUERIES[name](spark, small)
    con.execute(entries.SQL[name])
    columns = [x[0] for x in con.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    at = [columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in con.fetchall())
