"""Every registered query vs its DuckDB oracle on the smallest test tables,
plus the invariants the surveyed suite asserted (ranges, parts ≤ total)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from cadence.plans import catalog
from cadence.plans.oracle_map import oracle_sql
from tests.conftest import SMOKE_DIR

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((0, "") if v is None else (1, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    cols = sorted(df.columns)
    got = _sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = _sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle_sql())
    assert set(oracle_sql()) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SMOKE_DIR}/region.parquet").count()
    assert len({r.project_id for r in rows}) == len(rows) and any(r.velocity_sprints_analysed for r in rows)


def test_invariants(spark):
    q = E.queries()
    for r in q["sprint_completion"](spark, SMOKE_DIR).collect():
        assert 0 <= r.completion_pct_points <= 100 and 0 <= r.completion_pct_issues <= 100
        assert r.done_issues <= r.total_issues
        assert r.done_points + r.in_progress_points + r.todo_points <= r.total_points + 1e-9
    for r in q["scope_creep"](spark, SMOKE_DIR).collect():
        assert 0 <= r.scope_creep_pct <= 100
        assert r.added_issues + r.original_issues == r.total_issues
    shares = {}
    for r in q["distribution_by_status"](spark, SMOKE_DIR).collect():
        shares[r.project_id] = shares.get(r.project_id, 0) + r.pct_of_total
    assert all(abs(v - 100) < 0.05 for v in shares.values())
