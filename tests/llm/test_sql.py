"""Queries that SQL can state, against DuckDB."""

import os

import duckdb
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        at = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{at}')")
    df = queries.queries()[name](spark, DATA)
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    a = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(str(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert a == b
