"""Metrics of the seed fixture in plain Python, straight from their definitions."""

import statistics

import numpy as np

from tests.seed import ISSUES, SPRINTS


def r2(x):
    return None if x is None else round(float(x) + 1e-9, 2)


def pct(a, b):
    return r2(a / b * 100) if b else 0.0


def points(rows):
    return float(sum(i[4] or 0 for i in rows))


def sprint(sid, issues=ISSUES):
    """Counters of one sprint."""
    mine = [i for i in issues if i[1] == sid]
    done, mid = [i for i in mine if i[3] == "Done"], [i for i in mine if i[5]]
    rest = [i for i in mine if not i[5]]
    return {
        "total": len(mine), "done": len(done), "added": len(mid), "original": len(rest),
        "points": points(mine), "done_points": points(done), "added_points": points(mid), "committed": points(rest),
        "in_progress_points": points([i for i in mine if i[3] == "In Progress"]), "todo_points": points([i for i in mine if i[3] == "To Do"]),
        "added_keys": [i[0] for i in mid], "name": next(s[1] for s in SPRINTS if s[0] == sid),
    }


CLOSED = [s[0] for s in reversed(SPRINTS) if s[2] == "closed"]  # newest first
STARTED = [s[0] for s in reversed(SPRINTS)]


def velocity(window):
    """(completed, committed, predictability, sprints) of the last closed sprints."""
    rows = [sprint(s) for s in CLOSED[:window]]
    done, committed = statistics.mean(r["done_points"] for r in rows), statistics.mean(r["committed"] for r in rows)
    return r2(done), r2(committed), r2(done / committed * 100), len(rows)


def cycle_days(kind=None, sprint_id=None):
    return [float(i[6] - i[7]) for i in ISSUES if i[7] is not None and i[6] > i[7] and kind in (None, i[2]) and sprint_id in (None, i[1])]


def cycle(kind=None):
    """(n, mean, p50, p75, p95, stddev)."""
    d = cycle_days(kind)
    return (len(d), r2(statistics.mean(d)), *(r2(np.percentile(d, q)) for q in (50, 75, 95)), r2(statistics.stdev(d)) if len(d) > 1 else None)


def backlog():
    rows = [i for i in ISSUES if i[1] is None and i[3] != "Done"]
    ac = [i for i in rows if i[8]]
    pts = [i for i in rows if i[4] is not None]
    both = [i for i in ac if i[4] is not None]
    return len(rows), len(ac), len(pts), len(both)


def by_status(issues=ISSUES):
    total = points([i for i in issues if i[3]])
    out = {}
    for status in {i[3] for i in issues if i[3]}:
        mine = [i for i in issues if i[3] == status]
        out[status] = (len(mine), points(mine), pct(points(mine), total))
    return out


def by_type():
    keys = {(i[3], i[2]) for i in ISSUES}
    return {k: (n := [i for i in ISSUES if (i[3], i[2]) == k]) and (len(n), points(n)) for k in keys}


def band(value):
    return "green" if value >= 80 else "amber" if value >= 60 else "red"
