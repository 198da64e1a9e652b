"""Delivery metrics as DataFrame functions.

Every function takes a :class:`~cadence.sources.tables.Tables` and the
reference's parameters and returns a lazily planned ``DataFrame``.
``project_id=None`` computes every project in one job (one row group per
project) instead of one database round trip per project.

Plan shape shared by the sprint-grain metrics:

1. rank the (small) sprint table per project and keep the top ``n``;
2. semi-join issues to those sprints *before* aggregating, so only their
   issues are read past the scan and the aggregate is partial + final;
3. left-join the per-sprint aggregate back onto the ranked sprints so
   sprints without issues still report zeros.

Sprint and project frames are orders of magnitude smaller than issues; the
joins are left to AQE, which broadcasts them only when their measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a
shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import (
    count_if,
    cycle_days,
    iso,
    latest_n,
    pct,
    round2,
    sum_if,
)
from ..sources.tables import Tables

DONE = "Done"
IN_PROGRESS = "In Progress"
TO_DO = "To Do"
BACKLOG_TYPES = ("Story", "Bug", "Task")


class ProjectNotFound(LookupError):
    """Raised when a project key does not resolve (the reference's 404)."""


def check_bound(name: str, value: int | None, lo: int = 1, hi: int | None = 20) -> int | None:
    """Argument bounds of the reference API (window/limit 1…20)."""
    if value is None:
        return None
    if value < lo or (hi is not None and value > hi):
        raise ValueError(f"{name} must be between {lo} and {hi}, got {value}")
    return int(value)


def _for_project(df: DataFrame, project_id: int | None, col: str = "project_id") -> DataFrame:
    # Built at plan time so the equality reaches the Parquet scan / partition filter.
    return df if project_id is None else df.filter(F.col(col) == F.lit(project_id))


def _projects(t: Tables, project_id: int | None) -> DataFrame:
    return _for_project(t.projects.select(F.col("id").alias("project_id")), project_id)


# Sprint-grain aggregate shared by velocity, scope creep and completion

def _sprint_issue_agg(issues: DataFrame, sprint_keys: DataFrame) -> DataFrame:
    """Per-sprint issue counters, only for the sprints in ``sprint_keys``."""
    i = issues.filter(F.col("sprint_id").isNotNull()).join(
        sprint_keys.select(F.col("sprint_id")), "sprint_id", "left_semi"
    )
    done = F.col("status_category") == DONE
    mid = F.col("added_mid_sprint")
    sp = F.col("story_points")
    return i.groupBy("sprint_id").agg(
        F.count("id").alias("total_issues"),
        count_if(done).alias("done_issues"),
        count_if(mid).alias("added_issues"),
        count_if(~mid).alias("original_issues"),
        sum_if(done, sp).alias("completed_points"),
        sum_if(~mid, sp).alias("committed_points"),
        sum_if(mid, sp).alias("added_points"),
        F.coalesce(F.sum(sp), F.lit(0)).alias("total_points"),
        sum_if(F.col("status_category") == IN_PROGRESS, sp).alias("in_progress_points"),
        sum_if(F.col("status_category") == TO_DO, sp).alias("todo_points"),
    )


_ZERO_COUNTS = ("total_issues", "done_issues", "added_issues", "original_issues")
_ZERO_POINTS = (
    "completed_points", "committed_points", "added_points", "total_points",
    "in_progress_points", "todo_points",
)


def _counts_for(t: Tables, project_id: int | None, *rankings: DataFrame) -> DataFrame:
    """One per-sprint aggregate covering the sprints of every given ranking.

    The project filter on issues is static, so it prunes the ``project_id=``
    partitions of the issues table; the semi-join then keeps only ranked
    sprints before the (partial + final) aggregate.
    """
    keys = None
    for r in rankings:
        k = r.select(F.col("id").alias("sprint_id"))
        keys = k if keys is None else keys.unionByName(k)
    return _sprint_issue_agg(_for_project(t.issues, project_id), keys)


def _attach(ranked: DataFrame, agg: DataFrame) -> DataFrame:
    """Ranked sprints left-joined to their counters; sprints without issues get zeros."""
    joined = ranked.join(agg, ranked["id"] == agg["sprint_id"], "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _ZERO_COUNTS]
    filled += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _ZERO_POINTS]
    return joined.select(*[ranked[c] for c in ranked.columns], *filled)


def _ranked_with_counts(t: Tables, ranked: DataFrame, project_id: int | None = None) -> DataFrame:
    return _attach(ranked, _counts_for(t, project_id, ranked))


def closed_sprints_ranked(t: Tables, project_id: int | None, window: int | None) -> DataFrame:
    """Last ``window`` closed sprints by completion (NULL completion first, as in PostgreSQL)."""
    s = _for_project(t.sprints, project_id).filter(F.col("state") == "closed")
    return latest_n(s, window, [F.col("complete_date").desc_nulls_first(), F.col("id").desc()])


def started_sprints_ranked(t: Tables, project_id: int | None, limit: int | None) -> DataFrame:
    """Last ``limit`` active/closed sprints by start date (NULL start first)."""
    s = _for_project(t.sprints, project_id).filter(F.col("state").isin("active", "closed"))
    return latest_n(s, limit, [F.col("start_date").desc_nulls_first(), F.col("id").desc()])


# A1 / A2 velocity

def velocity_trend(t: Tables, project_id: int | None = None, window: int = 3) -> DataFrame:
    """Per closed sprint: completed/committed points and issue counts, last ``window``."""
    ranked = closed_sprints_ranked(t, project_id, window)
    return _trend_columns(_ranked_with_counts(t, ranked, project_id))


def _trend_columns(j: DataFrame) -> DataFrame:
    return j.select(
        "project_id",
        F.col("id").alias("sprint_id"),
        F.col("name").alias("sprint_name"),
        iso("complete_date").alias("complete_date"),
        iso("start_date").alias("start_date"),
        iso("end_date").alias("end_date"),
        round2("completed_points").alias("completed_points"),
        round2("committed_points").alias("committed_points"),
        "total_issues",
        "done_issues",
        # rank 1 = newest; chart order is oldest first
        F.col("rank").alias("recency_rank"),
    )


def velocity(t: Tables, project_id: int | None = None, window: int = 3, nested: bool = False) -> DataFrame:
    """Averages over the trend; projects without closed sprints report NULLs and 0."""
    return _velocity_from_trend(t, project_id, window, velocity_trend(t, project_id, window), nested)


def _velocity_from_trend(t: Tables, project_id: int | None, window: int, trend: DataFrame, nested: bool = False) -> DataFrame:
    aggs = [
        F.avg("completed_points").alias("_avg_c"),
        F.avg("committed_points").alias("_avg_k"),
        F.count(F.lit(1)).alias("sprints_analysed"),
    ]
    if nested:
        # Bounded by ``window`` elements per project; sorted oldest first.
        aggs.append(
            F.sort_array(
                F.collect_list(F.struct((-F.col("recency_rank")).alias("_o"), *[c for c in trend.columns if c != "project_id"]))
            ).alias("_trend")
        )
    per = trend.groupBy("project_id").agg(*aggs)
    out = _projects(t, project_id).join(per, "project_id", "left")
    k = F.col("_avg_k")
    cols = [
        "project_id",
        F.round("_avg_c", 2).alias("average_completed_points"),
        F.round(k, 2).alias("average_committed_points"),
        F.when(k.isNull() | (k == 0), F.lit(None).cast("double"))
        .otherwise(F.round(F.col("_avg_c") / k * F.lit(100.0), 2))
        .alias("predictability_pct"),
        F.coalesce(F.col("sprints_analysed"), F.lit(0)).cast("long").alias("sprints_analysed"),
        F.lit(window).cast("long").alias("window"),
    ]
    if nested:
        cols.append(F.coalesce(F.transform("_trend", lambda s: s.dropFields("_o")), F.array()).alias("trend"))
    return out.select(*cols)


# A3 / A4 scope creep

def scope_creep(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    ranked = started_sprints_ranked(t, project_id, limit)
    j = _ranked_with_counts(t, ranked, project_id)
    return j.select(
        "project_id",
        F.col("id").alias("sprint_id"),
        F.col("name").alias("sprint_name"),
        "state",
        iso("start_date").alias("start_date"),
        iso("end_date").alias("end_date"),
        "original_issues",
        "added_issues",
        "total_issues",
        round2("committed_points").alias("original_points"),
        round2("added_points").alias("added_points"),
        round2("total_points").alias("total_points"),
        pct("added_points", "total_points").alias("scope_creep_pct"),
        F.col("rank").alias("recency_rank"),
    )


def scope_creep_detail(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    """Issues added mid-sprint for the ranked sprints (flat form)."""
    ranked = started_sprints_ranked(t, project_id, limit).select(
        F.col("id").alias("sprint_id"), F.col("rank").alias("recency_rank")
    )
    i = _for_project(t.issues, project_id).filter(F.col("sprint_id").isNotNull() & (F.col("added_mid_sprint") == F.lit(True)))
    return i.join(ranked, "sprint_id").select(
        "project_id",
        "sprint_id",
        "jira_issue_id",
        "summary",
        "issue_type",
        "priority",
        "status",
        round2("story_points").alias("story_points"),
        "assignee_email",
        iso("created_at_jira").alias("created_at_jira"),
    )


def scope_creep_nested(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    """Scope creep with ``added_issue_detail`` as an array, created ascending.

    The detail list of one sprint is bounded by that sprint's own issues; it
    is built with one grouped ``collect_list`` instead of a query per sprint.
    """
    detail = scope_creep_detail(t, project_id, limit)
    key = F.struct(
        F.col("created_at_jira").isNull().alias("_n"),
        F.col("created_at_jira").alias("_c"),
        F.col("jira_issue_id").alias("_k"),
        F.struct(*[c for c in detail.columns if c not in ("project_id", "sprint_id")]).alias("d"),
    )
    per = detail.groupBy("sprint_id").agg(F.sort_array(F.collect_list(key)).alias("_d"))
    base = scope_creep(t, project_id, limit)
    return base.join(per, "sprint_id", "left").withColumn(
        "added_issue_detail", F.coalesce(F.transform("_d", lambda x: x["d"]), F.array())
    ).drop("_d")


# A5 / A6 cycle time

def cycle_time_distribution(
    t: Tables,
    project_id: int | None = None,
    issue_type: str | None = None,
    sprint_id: int | None = None,
) -> DataFrame:
    i = _for_project(t.issues, project_id)
    ip, done = F.col("in_progress_at"), F.col("done_at")
    i = i.filter(ip.isNotNull() & done.isNotNull() & (done > ip))
    if issue_type is not None:
        i = i.filter(F.col("issue_type") == F.lit(issue_type))
    if sprint_id is not None:
        i = i.filter(F.col("sprint_id") == F.lit(sprint_id))
    return i.select(
        "project_id",
        "id",
        "jira_issue_id",
        "summary",
        "issue_type",
        round2("story_points").alias("story_points"),
        "assignee_email",
        iso(ip).alias("in_progress_at"),
        iso(done).alias("done_at"),
        cycle_days(ip, done).alias("cycle_days"),
    )


def cycle_time(
    t: Tables,
    project_id: int | None = None,
    issue_type: str | None = None,
    sprint_id: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Mean, p50/p75/p95 (linear interpolation), sample stddev and n per project.

    Statistics run on the 2-dp rounded observations, as the reference does.
    ``percentile`` is exact and partially aggregated (a value→count map per
    group, bounded by the number of distinct 2-dp values); ``approximate``
    switches to ``percentile_approx`` for very large groups.
    """
    d = cycle_time_distribution(t, project_id, issue_type, sprint_id)
    x = F.col("cycle_days")
    probs = [0.5, 0.75, 0.95]
    q = F.percentile_approx(x, probs, 100000) if approximate else F.percentile(x, F.array(*[F.lit(p) for p in probs]))
    per = d.groupBy("project_id").agg(
        F.avg(x).alias("_mean"),
        q.alias("_q"),
        F.stddev_samp(x).alias("_sd"),
        F.count(x).alias("sample_size"),
    )
    out = _projects(t, project_id).join(per, "project_id", "left")
    return out.select(
        "project_id",
        F.round("_mean", 2).alias("mean_days"),
        F.round(F.col("_q")[0], 2).alias("p50_days"),
        F.round(F.col("_q")[1], 2).alias("p75_days"),
        F.round(F.col("_q")[2], 2).alias("p95_days"),
        F.round("_sd", 2).alias("stddev_days"),
        F.coalesce(F.col("sample_size"), F.lit(0)).cast("long").alias("sample_size"),
        F.lit(issue_type).cast("string").alias("issue_type"),
        F.lit(sprint_id).cast("long").alias("sprint_id"),
    )


# A7 sprint completion

def sprint_completion(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    ranked = started_sprints_ranked(t, project_id, limit)
    j = _ranked_with_counts(t, ranked, project_id)
    return j.select(
        "project_id",
        F.col("id").alias("sprint_id"),
        F.col("name").alias("sprint_name"),
        "state",
        iso("start_date").alias("start_date"),
        iso("end_date").alias("end_date"),
        iso("complete_date").alias("complete_date"),
        "total_issues",
        "done_issues",
        pct("done_issues", "total_issues").alias("completion_pct_issues"),
        round2("total_points").alias("total_points"),
        round2("completed_points").alias("done_points"),
        round2("in_progress_points").alias("in_progress_points"),
        round2("todo_points").alias("todo_points"),
        pct("completed_points", "total_points").alias("completion_pct_points"),
        F.col("rank").alias("recency_rank"),
    )


# A8 backlog readiness

def _backlog(t: Tables, project_id: int | None) -> DataFrame:
    return _for_project(t.issues, project_id).filter(
        (F.col("status_category") != DONE)
        & F.col("sprint_id").isNull()
        & F.col("issue_type").isin(*BACKLOG_TYPES)
    )


def backlog_by_type(t: Tables, project_id: int | None = None) -> DataFrame:
    """Open backlog counts per issue type (one grouped pass)."""
    b = _backlog(t, project_id)
    ac, pts = F.col("has_ac"), F.col("story_points").isNotNull()
    return b.groupBy("project_id", "issue_type").agg(
        F.count(F.lit(1)).alias("count"),
        count_if(ac).alias("with_ac"),
        count_if(pts).alias("with_points"),
        count_if(ac & pts).alias("fully_ready"),
    )


def backlog_readiness(t: Tables, project_id: int | None = None) -> DataFrame:
    """Totals rolled up from :func:`backlog_by_type`; empty projects report 0 / NULL."""
    by_type = backlog_by_type(t, project_id)
    tot = by_type.groupBy("project_id").agg(
        F.sum("count").alias("total_backlog"),
        F.sum("with_ac").alias("with_ac"),
        F.sum("with_points").alias("with_points"),
        F.sum("fully_ready").alias("fully_ready"),
    )
    out = _projects(t, project_id).join(tot, "project_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = F.lit(None).cast("double")
    return out.select(
        "project_id",
        zero("total_backlog"),
        zero("with_ac"),
        zero("with_points"),
        zero("fully_ready"),
        pct("with_ac", "total_backlog", none).alias("ac_readiness_pct"),
        pct("with_points", "total_backlog", none).alias("points_readiness_pct"),
        pct("fully_ready", "total_backlog", none).alias("full_readiness_pct"),
    )


# A9 story-point distribution

def distribution_by_type(t: Tables, project_id: int | None = None, sprint_id: int | None = None) -> DataFrame:
    i = _for_project(t.issues, project_id)
    if sprint_id is not None:
        i = i.filter(F.col("sprint_id") == F.lit(sprint_id))
    return i.groupBy("project_id", "status_category", "issue_type").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.coalesce(F.sum("story_points"), F.lit(0)).alias("_pts"),
    ).select(
        "project_id", "status_category", "issue_type",
        F.col("issue_count").cast("long").alias("issue_count"),
        round2("_pts").alias("total_points"),
    )


def distribution_by_status(t: Tables, project_id: int | None = None, sprint_id: int | None = None) -> DataFrame:
    """Re-aggregated by status; NULL status vanishes from rows *and* the grand total."""
    i = _for_project(t.issues, project_id)
    if sprint_id is not None:
        i = i.filter(F.col("sprint_id") == F.lit(sprint_id))
    per = (
        i.filter(F.col("status_category").isNotNull())
        .groupBy("project_id", "status_category")
        .agg(F.count(F.lit(1)).alias("issue_count"), F.coalesce(F.sum("story_points"), F.lit(0)).alias("_pts"))
    )
    # Grand total per project via a window over the (≤ a few) status rows of
    # each project — after the aggregate, so the window never sees issues.
    total = F.sum("_pts").over(Window.partitionBy("project_id"))
    return per.select(
        "project_id",
        "status_category",
        F.col("issue_count").cast("long").alias("issue_count"),
        round2("_pts").alias("total_points"),
        pct("_pts", total).alias("pct_of_total"),
    )


# A10 delivery health card

def delivery_health(t: Tables, project_id: int | None = None, velocity_window: int = 3) -> DataFrame:
    """One row per project: velocity, Story cycle time, backlog and latest started sprint.

    Two issue scans: the sprint counters of the ranked sprints, from which
    velocity and current sprint are conditional aggregates by project, and the
    Story and backlog numbers.
    """
    ranked = _health_sprints(t, project_id, velocity_window)
    j = _attach(ranked, _counts_for(t, project_id, ranked))
    # Completion and creep share one ranking (start_date desc, id desc), so
    # the latest started sprint gets both numbers from the same counters.
    current = F.struct("name", "completed_points", "total_points", "added_points")
    sprint_stats = j.groupBy("project_id").agg(
        F.avg(F.when(F.col("in_window"), round2("completed_points"))).alias("_c"),
        F.avg(F.when(F.col("in_window"), round2("committed_points"))).alias("_k"),
        count_if(F.col("in_window")).cast("long").alias("velocity_sprints_analysed"),
        F.max(F.when(F.col("is_current"), current)).alias("_cur"),
    )
    k = F.col("_k")
    sprint_stats = sprint_stats.select(
        "project_id",
        F.round("_c", 2).alias("velocity_average_completed_points"),
        F.when(k.isNotNull() & (k != 0), F.round(F.col("_c") / k * F.lit(100.0), 2)).alias("velocity_predictability_pct"),
        "velocity_sprints_analysed",
        F.col("_cur.name").alias("current_sprint_name"),
        F.when(F.col("_cur").isNotNull(), pct("_cur.completed_points", "_cur.total_points")).alias("current_sprint_completion_pct_points"),
        F.when(F.col("_cur").isNotNull(), pct("_cur.added_points", "_cur.total_points")).alias("current_sprint_scope_creep_pct"),
    )
    # Story cycle time and backlog readiness in ONE pass over issues: both
    # group by project, so each becomes conditional aggregates (NULLs are
    # ignored by percentile/avg/stddev/count) instead of a second scan.
    i = _for_project(t.issues, project_id)
    ip, done = F.col("in_progress_at"), F.col("done_at")
    story_obs = F.when(
        ip.isNotNull() & done.isNotNull() & (done > ip) & (F.col("issue_type") == "Story"), cycle_days(ip, done)
    )
    in_backlog = (
        (F.col("status_category") != DONE) & F.col("sprint_id").isNull() & F.col("issue_type").isin(*BACKLOG_TYPES)
    )
    stats = i.select("project_id", story_obs.alias("x"), in_backlog.alias("b"), F.col("has_ac").alias("ac"),
                     F.col("story_points").isNotNull().alias("pts")).groupBy("project_id").agg(
        F.avg("x").alias("_mean"),
        F.percentile(F.col("x"), F.array(F.lit(0.5), F.lit(0.95))).alias("_q"),
        F.count("x").alias("_n"),
        count_if(F.col("b")).alias("_bt"),
        count_if(F.col("b") & F.col("ac")).alias("_bac"),
        count_if(F.col("b") & F.col("ac") & F.col("pts")).alias("_bfull"),
    )
    none = F.lit(None).cast("double")
    per = stats.select(
        "project_id",
        F.round("_mean", 2).alias("cycle_mean_days"),
        F.round(F.col("_q")[0], 2).alias("cycle_p50_days"),
        F.round(F.col("_q")[1], 2).alias("cycle_p95_days"),
        F.col("_n").cast("long").alias("cycle_sample_size"),
        F.col("_bt").cast("long").alias("backlog_total"),
        pct("_bfull", "_bt", none).alias("backlog_full_readiness_pct"),
        pct("_bac", "_bt", none).alias("backlog_ac_readiness_pct"),
    )
    out = _projects(t, project_id).join(per, "project_id", "left").join(sprint_stats, "project_id", "left")
    counts = ("velocity_sprints_analysed", "cycle_sample_size", "backlog_total")
    return out.select(
        "project_id",
        *[(F.coalesce(F.col(c), F.lit(0)).cast("long") if c in counts else F.col(c)).alias(c) for c in HEALTH_COLUMNS],
    )


HEALTH_COLUMNS = (
    "velocity_average_completed_points", "velocity_predictability_pct", "velocity_sprints_analysed",
    "cycle_mean_days", "cycle_p50_days", "cycle_p95_days", "cycle_sample_size",
    "backlog_total", "backlog_full_readiness_pct", "backlog_ac_readiness_pct",
    "current_sprint_name", "current_sprint_completion_pct_points", "current_sprint_scope_creep_pct",
)


def _health_sprints(t: Tables, project_id: int | None, window: int) -> DataFrame:
    """Sprints of the velocity window (``in_window``) or latest started (``is_current``), ranked in one frame."""
    s = _for_project(t.sprints, project_id).filter(F.col("state").isin("active", "closed"))
    closed = F.col("state") == "closed"
    by_end = Window.partitionBy("project_id", "state").orderBy(F.col("complete_date").desc_nulls_first(), F.col("id").desc())
    by_start = Window.partitionBy("project_id").orderBy(F.col("start_date").desc_nulls_first(), F.col("id").desc())
    s = s.select(
        "id", "project_id", "name",
        (closed & (F.row_number().over(by_end) <= window)).alias("in_window"), (F.row_number().over(by_start) == 1).alias("is_current"),
    )
    return s.where("in_window or is_current")


def delivery_health_nested(t: Tables, project_id: int | None = None, velocity_window: int = 3) -> DataFrame:
    """The health card as nested sections, like the reference's response record."""
    h = delivery_health(t, project_id, velocity_window)
    cur = F.struct(
        F.col("current_sprint_name").alias("sprint_name"),
        F.col("current_sprint_completion_pct_points").alias("completion_pct_points"),
        F.col("current_sprint_scope_creep_pct").alias("scope_creep_pct"),
    )
    return h.select(
        "project_id",
        F.struct(
            F.col("velocity_average_completed_points").alias("average_completed_points"),
            F.col("velocity_predictability_pct").alias("predictability_pct"),
            F.col("velocity_sprints_analysed").alias("sprints_analysed"),
        ).alias("velocity"),
        F.struct(
            F.col("cycle_mean_days").alias("mean_days"),
            F.col("cycle_p50_days").alias("p50_days"),
            F.col("cycle_p95_days").alias("p95_days"),
            F.col("cycle_sample_size").alias("sample_size"),
        ).alias("cycle_time"),
        F.struct(
            F.col("backlog_total").alias("total"),
            F.col("backlog_full_readiness_pct").alias("full_readiness_pct"),
            F.col("backlog_ac_readiness_pct").alias("ac_readiness_pct"),
        ).alias("backlog"),
        F.when(F.col("current_sprint_name").isNotNull(), cur).alias("current_sprint"),
    )


# A11 time tracking

def _hours(c: Column) -> Column:
    # ROUND(SUM(seconds) / 3600.0, 1) in exact decimal; NULL when all inputs NULL.
    return F.round(F.sum(c).cast("decimal(38,0)") / F.lit(3600).cast("decimal(38,0)"), 1).cast("double")


def time_tracking(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    """Estimated vs spent hours for the latest ``limit`` non-future sprints that have issues."""
    per = _for_project(t.issues, project_id).filter(F.col("sprint_id").isNotNull()).groupBy("sprint_id").agg(
        _hours(F.col("original_estimate")).alias("estimated_hours"),
        _hours(F.col("time_spent")).alias("spent_hours"),
    )
    s = _for_project(t.sprints, project_id).filter(F.col("state") != "future")
    joined = s.join(per, s["id"] == per["sprint_id"])  # inner: sprints without issues drop out
    ranked = latest_n(joined, limit, [F.col("start_date").desc_nulls_last(), F.col("id").desc()])
    return ranked.select(
        "project_id",
        "sprint_id",
        F.col("name").alias("sprint_name"),
        "estimated_hours",
        "spent_hours",
        F.col("rank").alias("recency_rank"),
    )
