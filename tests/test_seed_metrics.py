"""Metrics of the seed fixture against plain Python (tests/brute.py)."""

from collections import Counter

import pytest

from cadence.operators import listing, metrics, views
from tests import brute
from tests.seed import ISSUES, SPRINTS

NAMES = {s[0]: s[1] for s in SPRINTS}
OLDEST_FIRST = [NAMES[s] for s in reversed(brute.CLOSED)]
NEWEST_FIRST = [NAMES[s] for s in brute.STARTED]


def by(rows, key):
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("window", [2, 3])
def test_velocity(seed, window):
    r = metrics.velocity(seed, 1, window).collect()[0]
    assert (r.average_completed_points, r.average_committed_points, r.predictability_pct, r.sprints_analysed) == brute.velocity(window)
    assert r.window == window


def test_velocity_trend_order_and_counts(seed):
    rows = sorted(metrics.velocity_trend(seed, 1, 3).collect(), key=lambda r: -r.recency_rank)
    assert [r.sprint_name for r in rows] == OLDEST_FIRST
    for r in rows:
        b = brute.sprint(r.sprint_id)
        assert (r.completed_points, r.committed_points, r.total_issues, r.done_issues) == (b["done_points"], b["committed"], b["total"], b["done"])


def test_velocity_nested_trend_oldest_first(seed):
    r = metrics.velocity(seed, 1, 3, nested=True).collect()[0]
    assert [t.sprint_name for t in r.trend] == OLDEST_FIRST


def test_scope_creep(seed):
    rows = sorted(metrics.scope_creep(seed, 1, 5).collect(), key=lambda r: r.recency_rank)
    assert [r.sprint_name for r in rows] == NEWEST_FIRST
    for r in rows:
        b = brute.sprint(r.sprint_id)
        assert r.scope_creep_pct == brute.pct(b["added_points"], b["points"])
        assert (r.added_issues, r.original_issues, r.total_issues) == (b["added"], b["original"], b["total"])
        assert (r.added_points, r.original_points, r.total_points) == (b["added_points"], b["committed"], b["points"])


def test_scope_creep_detail_and_nested(seed):
    want = sorted((i[1], i[0]) for i in ISSUES if i[5])
    assert sorted((r.sprint_id, r.jira_issue_id) for r in metrics.scope_creep_detail(seed, 1, 5).collect()) == want and want
    for r in metrics.scope_creep_nested(seed, 1, 5).collect():
        assert sorted(x.jira_issue_id for x in r.added_issue_detail) == sorted(brute.sprint(r.sprint_id)["added_keys"])


def test_worst_and_totals(seed):
    shares = {s: brute.pct(brute.sprint(s)["added_points"], brute.sprint(s)["points"]) for s in NAMES}
    w = views.worst_scope_sprint(seed, 1).collect()
    assert len(w) == 1 and w[0].scope_creep_pct == max(shares.values())
    assert views.scope_creep_totals(seed, 1).collect()[0].total_added_points == brute.points([i for i in ISSUES if i[5]])


@pytest.mark.parametrize("typ", [None, "Story", "Bug"])
def test_cycle_time(seed, typ):
    r = metrics.cycle_time(seed, 1, issue_type=typ).collect()[0]
    assert (r.sample_size, r.mean_days, r.p50_days, r.p75_days, r.p95_days, r.stddev_days) == brute.cycle(typ)
    assert r.issue_type == typ


def test_cycle_time_distribution_sprint_filter(seed):
    rows = metrics.cycle_time_distribution(seed, 1, sprint_id=2).collect()
    assert sorted(r.cycle_days for r in rows) == sorted(brute.cycle_days(sprint_id=2)) and rows


def test_sprint_completion(seed):
    for r in metrics.sprint_completion(seed, 1, 5).collect():
        b = brute.sprint(r.sprint_id)
        assert (r.completion_pct_points, r.completion_pct_issues) == (brute.pct(b["done_points"], b["points"]), brute.pct(b["done"], b["total"]))
        assert (r.done_points, r.in_progress_points, r.todo_points, r.total_points) == (
            b["done_points"], b["in_progress_points"], b["todo_points"], b["points"])


def test_backlog(seed):
    r = metrics.backlog_readiness(seed, 1).collect()[0]
    total, ac, pts, both = brute.backlog()
    assert (r.total_backlog, r.with_ac, r.with_points, r.fully_ready) == (total, ac, pts, both)
    assert (r.ac_readiness_pct, r.points_readiness_pct, r.full_readiness_pct) == tuple(brute.pct(x, total) for x in (ac, pts, both))
    t = {x.issue_type: x["count"] for x in metrics.backlog_by_type(seed, 1).collect()}
    assert t == Counter(i[2] for i in ISSUES if i[1] is None)


def test_distribution(seed):
    s = {r.status_category: (r.issue_count, r.total_points, r.pct_of_total) for r in metrics.distribution_by_status(seed, 1).collect()}
    assert s == brute.by_status()
    t = {(r.status_category, r.issue_type): (r.issue_count, r.total_points) for r in metrics.distribution_by_type(seed, 1).collect()}
    assert t == brute.by_type()


def test_distribution_pivot_and_share(seed):
    cell = lambda status, typ: brute.by_type().get((status, typ), (0, 0.0))[1]
    types = {i[2] for i in ISSUES}
    p = {r.issue_type: (r.todo_points, r.in_progress_points, r.done_points) for r in views.distribution_pivot(seed, 1).collect()}
    assert p == {t: tuple(cell(s, t) for s in ("To Do", "In Progress", "Done")) for t in types}
    for r in views.distribution_type_share(seed, 1).collect():
        assert r.share_pct == int(cell(r.status_category, r.issue_type) / sum(p[r.issue_type]) * 100 + 0.5)


def test_health(seed):
    h = metrics.delivery_health(seed, 1).collect()[0]
    v, c, (total, ac, _, both), now = brute.velocity(3), brute.cycle("Story"), brute.backlog(), brute.sprint(brute.STARTED[0])
    assert (h.velocity_average_completed_points, h.velocity_predictability_pct, h.velocity_sprints_analysed) == (v[0], v[2], v[3])
    assert (h.cycle_mean_days, h.cycle_p50_days, h.cycle_p95_days, h.cycle_sample_size) == (c[1], c[2], c[4], c[0])
    assert (h.backlog_total, h.backlog_full_readiness_pct, h.backlog_ac_readiness_pct) == (total, brute.pct(both, total), brute.pct(ac, total))
    assert (h.current_sprint_name, h.current_sprint_completion_pct_points, h.current_sprint_scope_creep_pct) == (
        now["name"], brute.pct(now["done_points"], now["points"]), brute.pct(now["added_points"], now["points"]))
    assert metrics.delivery_health_nested(seed, 1).collect()[0].current_sprint.sprint_name == now["name"]


def test_kpi_rows(seed):
    rows = sorted(views.kpi_rows(seed, 1).collect(), key=lambda r: r.pos)
    v, c, (total, ac, _, both), now = brute.velocity(3), brute.cycle("Story"), brute.backlog(), brute.sprint(brute.STARTED[0])
    one = lambda x: f"{x + 1e-9:.1f}"
    assert [r.value for r in rows] == [
        one(v[2]) + "%", one(c[1]) + "d", one(brute.pct(both, total)) + "%", one(brute.pct(now["done_points"], now["points"])) + "%"]
    assert rows[1].quality == ("green" if c[1] <= 5 else "amber" if c[1] <= 10 else "red")
    assert rows[0].sub == f"Avg {one(v[0])} pts / sprint" and rows[1].sub == f"p95 = {one(c[4])}d  ·  n={c[0]}"
    assert rows[2].sub == f"{total} items  ·  {one(brute.pct(ac, total))}% with AC" and rows[3].sub == now["name"]


def test_time_tracking(seed):
    rows = sorted(metrics.time_tracking(seed, 1, 5).collect(), key=lambda r: -r.recency_rank)
    assert [r.sprint_name for r in rows] == NEWEST_FIRST[::-1]
    assert all(r.estimated_hours is None and r.spent_hours is None for r in rows)


def test_listing(seed):
    assert listing.resolve_project_id(seed, "team") == 1
    with pytest.raises(metrics.ProjectNotFound):
        listing.resolve_project_id(seed, "nope")
    assert listing.default_project(seed, "TEAM").collect()[0].jira_key == "TEAM"
    assert listing.default_project(seed, "absent").collect()[0].jira_key == "TEAM"
    assert sorted(r.name for r in listing.sprint_list(seed, 1, state="closed").collect()) == OLDEST_FIRST


def test_api_facade(seed):
    from cadence.api import DeliveryAnalytics, to_json_rows

    api = DeliveryAnalytics(seed)
    v = api.velocity("team", 3).collect()[0]
    assert v.average_completed_points == brute.velocity(3)[0] and [t.sprint_name for t in v.trend] == OLDEST_FIRST
    assert [r.sprint_name for r in api.scope_creep("TEAM").collect()] == NEWEST_FIRST
    assert api.health("Team").collect()[0].backlog.total == brute.backlog()[0]
    b = api.backlog("team").collect()[0]
    assert dict((x.issue_type, x["count"]) for x in b.by_issue_type) == Counter(i[2] for i in ISSUES if i[1] is None)
    with pytest.raises(ValueError):
        api.velocity("team", 25)
    with pytest.raises(metrics.ProjectNotFound):
        api.health("missing")
    assert f'"sample_size":{brute.cycle()[0]}' in to_json_rows(api.cycle_time("team")).collect()[0].json
    assert [r.name for r in api.sprints("team").collect()] == NEWEST_FIRST
    assert [r.sprint_name for r in api.sprint_completion("team", 2).collect()] == NEWEST_FIRST[:2]
    assert [r.sprint_name for r in api.time_tracking("team", 2).collect()] == NEWEST_FIRST[:2][::-1]
    by_status, by_type = api.distribution("team")
    assert [r.status_category for r in by_status.collect()] == ["Done", "In Progress", "To Do"]
    assert by_type.count() == len(brute.by_type())
    newest = sorted((i for i in ISSUES if i[2] == "Bug" and i[7] is not None), key=lambda i: i[7])
    assert [r.jira_issue_id for r in api.cycle_time_distribution("team", issue_type="Bug").collect()] == [i[0] for i in newest]
    assert api.project("TeAm").collect()[0].jira_key == "TEAM"
    assert [r.jira_key for r in api.meta().collect()] == ["TEAM"]


def test_bounds():
    assert metrics.check_bound("window", 3) == 3
    with pytest.raises(ValueError):
        metrics.check_bound("window", 21)
    with pytest.raises(ValueError):
        metrics.check_bound("limit", 0)


def test_views_bands(seed):
    for r in views.scope_creep_band(seed, 1).collect():
        b = brute.sprint(r.sprint_id)
        share = brute.pct(b["added_points"], b["points"])
        assert r.band == ("green" if share == 0 else "amber" if share <= 10 else "red")
    for r in views.completion_rag(seed, 1).collect():
        b = brute.sprint(r.sprint_id)
        assert r.band == brute.band(brute.pct(b["done_points"], b["points"]))
    for r in views.sprint_predictability(seed, 1).collect():
        b = next(brute.sprint(s) for s, n in NAMES.items() if n == r.sprint_name)
        assert r.predictability_pct == int(b["done_points"] / b["committed"] * 100 + 0.5)
    for r in views.sprint_progress_share(seed, 1).collect():
        b = brute.sprint(r.sprint_id)
        assert (r.done_share, r.in_progress_share, r.todo_share) == tuple(brute.pct(b[k], b["points"]) for k in ("done_points", "in_progress_points", "todo_points"))


def test_health_card_scans_issues_twice(spark, seed, tmp_path):
    from cadence.sources.tables import load_tables, write_tables

    write_tables(seed, str(tmp_path / "silver"))
    card = metrics.delivery_health(load_tables(spark, str(tmp_path / "silver")))
    plan = card._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "jira_issue_id" in line for line in plan.split("\n")) == 2
    assert sorted(map(str, card.collect())) == sorted(map(str, metrics.delivery_health(seed).collect()))
