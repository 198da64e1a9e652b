"""Sprint metrics vs a plain-Python brute force on random small tables."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadence.operators import metrics
from cadence.sources import schemas
from cadence.sources.tables import Tables

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)

sprint_st = st.tuples(
    st.integers(1, 2),                                  # project
    st.sampled_from(["closed", "active", "future"]),
    st.one_of(st.none(), st.integers(0, 6)),            # start day
    st.one_of(st.none(), st.integers(0, 6)),            # complete day
)
issue_st = st.tuples(
    st.integers(0, 7),                                  # sprint index (or backlog when out of range)
    st.sampled_from(["Done", "In Progress", "To Do", None]),
    st.one_of(st.none(), st.integers(0, 8)),            # half points
    st.booleans(),                                      # added mid-sprint
)


def build(spark, sprints, issues):
    p = [(pid, f"P{pid}", f"Project {pid}", None, None, None, None, None, None) for pid in (1, 2)]
    s = [
        (n + 1, n + 1, proj, f"S{n + 1}", state, None,
         None if sd is None else BASE + timedelta(days=sd), None,
         None if cd is None else BASE + timedelta(days=cd), None, None)
        for n, (proj, state, sd, cd) in enumerate(sprints)
    ]
    rows = []
    for n, (si, cat, half, mid) in enumerate(issues):
        sprint = s[si] if si < len(s) else None
        rows.append((
            n + 1, f"K-{n + 1}", sprint[2] if sprint else 1, sprint[0] if sprint else None, "Story", None,
            cat or "x", cat, "s", None, None, False,
            None if half is None else Decimal(half) / 2, None, None, None, None, None,
            None, None, None, None, None, mid, None, None,
        ))
    return Tables(
        projects=spark.createDataFrame(p, schemas.PROJECTS),
        sprints=spark.createDataFrame(s, schemas.SPRINTS),
        issues=spark.createDataFrame(rows, schemas.ISSUES),
    ), s, rows


def latest(sprints, states, key, n):
    """PostgreSQL order: key DESC with NULLs first, then id DESC; first n per project."""
    out = {}
    for proj in (1, 2):
        cand = [x for x in sprints if x[2] == proj and x[4] in states]
        cand.sort(key=lambda x: (x[key] is not None, -(x[key].timestamp() if x[key] else 0), -x[0]))
        out.update({x[0]: r + 1 for r, x in enumerate(cand[:n])})
    return out


def counters(rows, sid):
    mine = [r for r in rows if r[3] == sid]
    pts = lambda r: r[12] or 0
    return {
        "completed": sum(pts(r) for r in mine if r[7] == "Done"),
        "committed": sum(pts(r) for r in mine if not r[23]),
        "added": sum(pts(r) for r in mine if r[23]),
        "total": sum(pts(r) for r in mine),
        "n": len(mine),
        "done_n": sum(1 for r in mine if r[7] == "Done"),
    }


def pct(a, b):
    return 0.0 if not b else round(float(a) / float(b) * 100, 2)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sprints=st.lists(sprint_st, min_size=1, max_size=6), issues=st.lists(issue_st, max_size=25))
def test_sprint_metrics_match_brute_force(spark, sprints, issues):
    t, s, rows = build(spark, sprints, issues)

    want_v = {}
    for sid, rank in latest(s, {"closed"}, 8, 3).items():
        c = counters(rows, sid)
        want_v[sid] = (rank, float(c["completed"]), float(c["committed"]), c["n"], c["done_n"])
    got_v = {r.sprint_id: (r.recency_rank, r.completed_points, r.committed_points, r.total_issues, r.done_issues)
             for r in metrics.velocity_trend(t, None, 3).collect()}
    assert got_v == want_v

    want_c = {}
    for sid, rank in latest(s, {"active", "closed"}, 6, 2).items():
        c = counters(rows, sid)
        want_c[sid] = (rank, pct(c["added"], c["total"]), pct(c["completed"], c["total"]), pct(c["done_n"], c["n"]))
    sc = {r.sprint_id: r for r in metrics.scope_creep(t, None, 2).collect()}
    comp = {r.sprint_id: r for r in metrics.sprint_completion(t, None, 2).collect()}
    got_c = {k: (sc[k].recency_rank, sc[k].scope_creep_pct, comp[k].completion_pct_points, comp[k].completion_pct_issues)
             for k in sc}
    assert got_c == want_c
