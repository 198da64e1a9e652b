"""Cycle-time statistics from histograms, and pages of nested detail."""

import json
import statistics

import numpy as np
from pyspark.sql import functions as F

from cadence.api import json_text
from cadence.operators import histograms, metrics


def _hist(spark, rows):
    return spark.createDataFrame(rows, "project_id long, issue_type string, v double, n long").select("project_id", "issue_type", F.col("v").cast(histograms.DAYS).alias("days"), "n")


def test_statistics_equal_those_of_the_values(spark):
    rng = np.random.default_rng(4)
    groups = {(1, "Story"): [1.0], (1, None): [0.01, 3.25], (2, "Bug"): np.round(rng.gamma(2, 60, 5000), 2).tolist(), (2, "Task"): [2.5] * 1000 + [900.0], (3, "Bug"): [7.0] * 3}
    rows = [(p, t, v, 1) for (p, t), vs in groups.items() for v in vs]
    # Two parts of the rows, counted apart, merge into the same histogram.
    parts = _hist(spark, rows[::2]).groupBy("project_id", "issue_type", "days").agg(F.sum("n").alias("n")).unionByName(_hist(spark, rows[1::2]))
    found = {(r.project_id, r.issue_type): r for r in histograms.statistics(parts).collect()}
    assert set(found) == set(groups)
    for key, vs in groups.items():
        r = found[key]
        want = [np.mean(vs), *np.percentile(vs, [50, 75, 95])]
        assert np.allclose([r.mean_days, r.p50_days, r.p75_days, r.p95_days], want, atol=0.0051) and r.sample_size == len(vs)
        assert (r.stddev_days is None) == (len(vs) == 1) and (len(vs) == 1 or abs(r.stddev_days - statistics.stdev(vs)) < 0.0051)


def test_statistics_agree_with_the_percentile_aggregate(spark, seed):
    want = {r.project_id: r for r in metrics.cycle_time(seed).where("sample_size > 0").collect()}
    for r in histograms.statistics(histograms.cycle_histogram(seed), ("project_id",)).collect():
        assert [r[c] for c in ("mean_days", "p50_days", "p75_days", "p95_days", "stddev_days", "sample_size")] == [
            want[r.project_id][c] for c in ("mean_days", "p50_days", "p75_days", "p95_days", "stddev_days", "sample_size")
        ]
    assert histograms.statistics(_hist(spark, [])).collect() == []


def _large(seed, spark, n):
    """A sprint of ``n`` mid-sprint issues: many at one instant, some without one."""
    sprint = seed.sprints.where("state = 'active'").select("id", "project_id").first()
    base = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in seed.issues.schema.fields}
    base |= {
        "id": (F.col("id") + 10**6).alias("id"), "jira_issue_id": F.format_string("L-%06d", "id").alias("jira_issue_id"), "project_id": F.lit(sprint.project_id).cast("long").alias("project_id"),
        "sprint_id": F.lit(sprint.id).cast("long").alias("sprint_id"), "added_mid_sprint": F.lit(True).alias("added_mid_sprint"),
        "created_at_jira": F.when(F.col("id") % 10 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3 * 86400)).alias("created_at_jira"),
    }
    return seed.with_(issues=spark.range(n).select(*(base[f.name] for f in seed.issues.schema.fields))), sprint.id


def test_pages_of_a_sprint_of_100_000_issues(spark, seed):
    t, sprint = _large(seed, spark, 100_000)
    pages = histograms.scope_creep_pages(t, page_size=1000).persist()
    sizes = pages.select("page", "next_page", F.size("issues").alias("n")).orderBy("page").collect()
    assert [(r.page, r.next_page, r.n) for r in sizes] == [(i, i + 1 if i < 99 else None, 1000) for i in range(100)]
    first, last = (pages.where(F.col("page") == p).first().issues for p in (0, 99))
    assert [x.jira_issue_id for x in first[:3]] == ["L-000003", "L-000006", "L-000009"] and all(x.created_at_jira is None for x in last)
    every = pages.select(F.explode("issues.jira_issue_id").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).first()
    assert every.n == every.d == 100_000
    pages.unpersist()


def test_pages_hold_the_nested_detail(spark, seed):
    want = {r.sprint_id: [x.jira_issue_id for x in r.added_issue_detail] for r in metrics.scope_creep_nested(seed).collect() if r.added_issue_detail}
    found = {}
    for r in sorted(json_text(histograms.scope_creep_pages(seed, page_size=2)).collect(), key=lambda r: json.loads(r.json)["page"]):
        page = json.loads(r.json)
        found.setdefault(page["sprint_id"], []).extend(x["jira_issue_id"] for x in page["issues"])
        assert len(page["issues"]) <= 2 and set(page["issues"][0]) == set(histograms.DETAIL)
    assert found == want
