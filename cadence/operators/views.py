"""Dashboard-side transformations of the metric results, as DataFrame steps.

The reference finishes these in the browser per project; here they are
column expressions and small grouped steps over the metric frames, so they
run for every project at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_double, fmt_number, rag
from ..functions.ranking import row_number_by_group
from ..sources.tables import Tables
from . import metrics

STATUS_CATEGORIES = ("To Do", "In Progress", "Done")
CHART_WINDOW = 6  # the velocity chart asks for six sprints


# ── velocity chart ───────────────────────────────────────────────────────────

def sprint_predictability(t: Tables, project_id: int | None = None, window: int = CHART_WINDOW) -> DataFrame:
    """Completed / committed per sprint, 0 dp; NULL unless both are non-zero."""
    tr = metrics.velocity_trend(t, project_id, window)
    c, k = F.col("completed_points"), F.col("committed_points")
    both = c.isNotNull() & k.isNotNull() & (c != 0) & (k != 0)
    return tr.select(
        "project_id", "sprint_id", "sprint_name", "completed_points", "committed_points",
        F.when(both, F.round(c / k * F.lit(100.0), 0)).alias("predictability_pct"),
    )


def velocity_rag(t: Tables, project_id: int | None = None, window: int = CHART_WINDOW) -> DataFrame:
    """Bar colour: completed/committed ratio ≥ .8 green, ≥ .6 amber, else red (0 committed → red)."""
    tr = metrics.velocity_trend(t, project_id, window)
    c = F.coalesce(F.col("completed_points"), F.lit(0.0))
    k = F.coalesce(F.col("committed_points"), F.lit(0.0))
    ratio = F.when(k > 0, c / k).otherwise(F.lit(0.0))
    band = F.when(ratio >= 0.8, "green").when(ratio >= 0.6, "amber").otherwise("red")
    return tr.select("project_id", "sprint_id", "sprint_name", band.alias("band"))


def short_name(name: Column) -> Column:
    """``Team Sprint 24`` → ``Spr 24``; otherwise the first 10 characters plus an ellipsis."""
    m = F.regexp_extract(name, r"(?i)(\w*sprint\w*\s*\d+)", 1)
    shortened = F.regexp_replace(m, r"(?i)^(.*?)sprint", "$1Spr")
    cut = F.when(F.length(name) > 10, F.concat(F.substring(name, 1, 10), F.lit("…"))).otherwise(name)
    return F.when(m != "", shortened).otherwise(cut)


def sprint_short_name(t: Tables) -> DataFrame:
    s = t.sprints.select(F.lit("sprint").alias("kind"), "id", "name")
    p = t.projects.select(F.lit("project").alias("kind"), "id", "name")
    both = s.unionByName(p)
    return both.select("kind", "id", "name", short_name(F.coalesce(F.col("name"), F.lit(""))).alias("short_name"))


# ── scope-creep badge ────────────────────────────────────────────────────────

def scope_creep_totals(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    sc = metrics.scope_creep(t, project_id, limit)
    return sc.groupBy("project_id").agg(
        F.round(F.sum(F.coalesce(F.col("added_points"), F.lit(0.0))), 2).alias("total_added_points"),
        F.count(F.lit(1)).alias("sprints_shown"),
    )


def worst_scope_sprint(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    """Highest creep % per project; ties go to the newest (first listed); none when all are 0."""
    sc = metrics.scope_creep(t, project_id, limit).filter(F.coalesce(F.col("scope_creep_pct"), F.lit(0.0)) > 0)
    best = F.max_by(
        F.struct("sprint_id", "sprint_name", "scope_creep_pct", "added_issues"),
        F.struct(F.col("scope_creep_pct"), (-F.col("recency_rank")).alias("r")),
    )
    return sc.groupBy("project_id").agg(best.alias("w")).select("project_id", "w.*")


def scope_creep_band(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    sc = metrics.scope_creep(t, project_id, limit)
    p = F.coalesce(F.col("scope_creep_pct"), F.lit(0.0))
    band = F.when(p == 0, "green").when(p <= 10, "amber").otherwise("red")
    return sc.select("project_id", "sprint_id", "scope_creep_pct", band.alias("band"))


# ── cycle-time scatter ───────────────────────────────────────────────────────

ID_BLOCK = 65_536  # ids of rows that are sorted together when they share an instant


def cycle_time_scatter(t: Tables, project_id: int | None = None) -> DataFrame:
    """Scatter index ``i+1`` in result order (newest done first, then id)."""
    d = metrics.cycle_time_distribution(t, project_id).filter(F.col("cycle_days").isNotNull())
    d = d.select("project_id", "id", "cycle_days", "done_at")
    # A hot project is split over many tasks (see functions.ranking): by day,
    # then minute, then blocks of ids among equal instants of a minute's rows.
    instant = F.col("done_at")
    levels = [[(F.to_date(instant), False)], [(F.date_trunc("MINUTE", instant), False)], [(instant, False), (F.floor(F.col("id") / ID_BLOCK), True)]]
    ranked = row_number_by_group(d, "project_id", [instant.desc_nulls_first(), F.col("id").asc()], levels)
    return ranked.select("project_id", "id", "cycle_days", "idx")


# ── sprint completion ────────────────────────────────────────────────────────

def sprint_progress_share(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    """Done / in-progress / to-do shares of the sprint's total points (NULL when total is 0)."""
    sc = metrics.sprint_completion(t, project_id, limit)
    total = F.coalesce(F.col("total_points"), F.lit(0.0))

    def share(c: str) -> Column:
        v = F.coalesce(F.col(c), F.lit(0.0))
        return F.when(total != 0, F.round(v / total * F.lit(100.0), 2))

    return sc.select(
        "project_id", "sprint_id",
        share("done_points").alias("done_share"),
        share("in_progress_points").alias("in_progress_share"),
        share("todo_points").alias("todo_share"),
    )


def completion_rag(t: Tables, project_id: int | None = None, limit: int = 5) -> DataFrame:
    sc = metrics.sprint_completion(t, project_id, limit)
    v = F.coalesce(F.col("completion_pct_points"), F.lit(0.0))
    return sc.select("project_id", "sprint_id", "completion_pct_points", rag(v, null_band=None).alias("band"))


# ── distribution chart ───────────────────────────────────────────────────────

def distribution_pivot(t: Tables, project_id: int | None = None) -> DataFrame:
    """Issue type × {To Do, In Progress, Done} points; missing cells are 0."""
    bt = metrics.distribution_by_type(t, project_id).filter(
        F.col("issue_type").isNotNull() & (F.col("issue_type") != "")
    )
    pv = (
        bt.groupBy("project_id", "issue_type")
        .pivot("status_category", list(STATUS_CATEGORIES))
        .agg(F.sum("total_points"))
    )
    names = {"To Do": "todo_points", "In Progress": "in_progress_points", "Done": "done_points"}
    return pv.select(
        "project_id", "issue_type",
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(names[c]) for c in STATUS_CATEGORIES],
    )


def distribution_type_share(t: Tables, project_id: int | None = None) -> DataFrame:
    """Each category's share of its issue type's points, 0 dp (0 when the type has no points)."""
    pv = distribution_pivot(t, project_id)
    total = F.col("todo_points") + F.col("in_progress_points") + F.col("done_points")
    cells = F.array(
        *[F.struct(F.lit(c).alias("status_category"), F.col(n).alias("points"))
          for c, n in zip(STATUS_CATEGORIES, ("todo_points", "in_progress_points", "done_points"))]
    )
    long = pv.select("project_id", "issue_type", total.alias("type_total"), F.inline(cells))
    return long.select(
        "project_id", "issue_type", "status_category", "points",
        F.when(F.col("type_total") > 0, F.round(F.col("points") / F.col("type_total") * F.lit(100.0), 0))
        .otherwise(F.lit(0.0)).alias("share_pct"),
    )


# ── dashboard KPI row ────────────────────────────────────────────────────────

def _fmt(c: str | Column, suffix: str) -> Column:
    # toFixed(1) picks the larger neighbour on an exact tie; rounding half-up
    # to 1 dp first gives the same text in every engine.
    return fmt_number(F.round(as_double(F.col(c) if isinstance(c, str) else c), 1), suffix, 1)


def kpi_rows(t: Tables, project_id: int | None = None, velocity_window: int = 3) -> DataFrame:
    """Four (label, value, sub, quality) rows per project from the health card."""
    h = metrics.delivery_health(t, project_id, velocity_window)
    mean = F.col("cycle_mean_days")
    ct_quality = (
        F.when(mean.isNull(), "grey").when(mean <= 5, "green").when(mean <= 10, "amber").otherwise("red")
    )
    has_sprint = F.col("current_sprint_name").isNotNull()
    rows = F.array(
        F.struct(
            F.lit(1).alias("pos"), F.lit("Predictability").alias("label"),
            _fmt("velocity_predictability_pct", "%").alias("value"),
            F.concat(F.lit("Avg "), _fmt("velocity_average_completed_points", " pts"), F.lit(" / sprint")).alias("sub"),
            rag("velocity_predictability_pct").alias("quality"),
        ),
        F.struct(
            F.lit(2).alias("pos"), F.lit("Mean Cycle Time").alias("label"),
            _fmt("cycle_mean_days", "d").alias("value"),
            F.concat(F.lit("p95 = "), _fmt("cycle_p95_days", "d"), F.lit("  ·  n="),
                     F.col("cycle_sample_size").cast("string")).alias("sub"),
            ct_quality.alias("quality"),
        ),
        F.struct(
            F.lit(3).alias("pos"), F.lit("Backlog Readiness").alias("label"),
            _fmt("backlog_full_readiness_pct", "%").alias("value"),
            F.concat(F.col("backlog_total").cast("string"), F.lit(" items  ·  "),
                     _fmt("backlog_ac_readiness_pct", "% with AC")).alias("sub"),
            rag("backlog_full_readiness_pct").alias("quality"),
        ),
        F.struct(
            F.lit(4).alias("pos"), F.lit("Sprint Completion").alias("label"),
            F.when(has_sprint, _fmt("current_sprint_completion_pct_points", "%")).otherwise(F.lit("—")).alias("value"),
            F.when(has_sprint, F.col("current_sprint_name")).otherwise(F.lit("No active sprint")).alias("sub"),
            rag("current_sprint_completion_pct_points").alias("quality"),
        ),
    )
    return h.select("project_id", F.inline(rows)).withColumn("pos", F.col("pos").cast("long"))
