"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from cadence.llm import queries
from tests.conftest import SMOKE_DIR


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMOKE_DIR).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
