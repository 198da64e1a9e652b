"""A small fixture made by rule (FIXTURES.md §1), as DataFrames.

``now`` is fixed at 2024-06-30T00:00:00Z; dates are days before ``now``.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from cadence.sources import schemas
from cadence.sources.tables import Tables

NOW = datetime(2024, 6, 30, tzinfo=timezone.utc)


def ago(days):
    return None if days is None else NOW - timedelta(days=days)


def _sprint(n):
    """Two-week sprints, one after the other; the last is active and ends after ``NOW``."""
    start = 16 * (4 - n) + 6
    return (n, f"Cycle {n}", "closed" if n < 4 else "active", start, start - 14, start - 13 if n < 4 else None)


def _issue(k):
    """Issue k by fixed rules: every fifth is backlog, statuses and types cycle, points repeat with gaps."""
    sprint = k % 5 or None
    status = ("Done", "To Do", "Done", "In Progress", "Done", "Done", "To Do")[k * 3 % 7] if sprint else "To Do"
    begun = None if status == "To Do" else _sprint(sprint)[3] - k % 3
    return (
        f"TEAM-{k}", sprint, ("Story", "Bug", "Story", "Task")[k % 4], status, None if k % 13 == 0 else 1 + k * 5 % 9,
        sprint is not None and k % 7 == 3, begun, begun - 2 - k % 5 if status == "Done" else None, f"Given case {k}" if k % 3 == 1 else None,
    )


# id, name, state, start, end, complete
SPRINTS = [_sprint(n) for n in range(1, 5)]
# key, sprint, type, status, points, mid, in_progress, done, ac
ISSUES = [_issue(k) for k in range(1, 24)]


def project_rows(projects=((1, "TEAM", "Team Project"),)):
    return [
        (pid, key, name, None, None, None, None, NOW, NOW) for pid, key, name in projects
    ]


def sprint_rows(sprints=SPRINTS, project_id=1):
    return [
        (sid, sid, project_id, name, state, None, ago(s), ago(e), ago(c), NOW, NOW)
        for sid, name, state, s, e, c in sprints
    ]


def issue_rows(issues=ISSUES, project_id=1, first_id=1):
    out = []
    for n, (key, sprint, typ, status, pts, mid, ip, done, ac) in enumerate(issues):
        ac_present = ac is not None and ac.strip() != ""
        out.append((
            first_id + n, key, project_id, sprint, typ, None, status, status, f"Summary for {key}", None, ac,
            ac_present, None if pts is None else Decimal(pts).quantize(Decimal("0.1")), None, None, None, None, None,
            ago(60), None, ago(ip), ago(done), None, mid, NOW, NOW,
        ))
    return out


def make_tables(spark, projects=None, sprints=None, issues=None) -> Tables:
    return Tables(
        projects=spark.createDataFrame(projects if projects is not None else project_rows(), schemas.PROJECTS),
        sprints=spark.createDataFrame(sprints if sprints is not None else sprint_rows(), schemas.SPRINTS),
        issues=spark.createDataFrame(issues if issues is not None else issue_rows(), schemas.ISSUES),
        status_history=spark.createDataFrame([], schemas.STATUS_HISTORY),
        sync_log=spark.createDataFrame([], schemas.SYNC_LOG),
    )


def seed_tables(spark) -> Tables:
    t = make_tables(spark)
    # Materialise the tiny seed once for the whole test session.
    return Tables(
        projects=t.projects.cache(), sprints=t.sprints.cache(), issues=t.issues.cache(),
        status_history=t.status_history, sync_log=t.sync_log,
    )
