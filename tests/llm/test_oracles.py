"""Queries with SQL, against DuckDB."""

import os

import duckdb
import pytest

from tests.test_queries import rows
from tidewire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def test_ten_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
