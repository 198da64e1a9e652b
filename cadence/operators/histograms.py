"""Cycle-time statistics from value histograms, and nested detail in pages of bounded size.

A histogram has one row for each (project, type, cycle days to 2 dp): it is a
grouped count, so parts of it (of partitions, days or micro-batches) merge by
adding counts. Mean and deviation are exact decimal moments of the counts, and
percentiles are read off running counts with linear interpolation; no group's
values meet in one map or list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import row_number_by_group
from ..sources.tables import Tables
from . import metrics

DAYS = "decimal(18,2)"
PERCENTILES = {"p50_days": 0.5, "p75_days": 0.75, "p95_days": 0.95}
#: Values (in hundredths of a day) of a histogram whose running counts are summed together.
CELL = 4_096


def cycle_histogram(t: Tables, project_id: int | None = None) -> DataFrame:
    """Rows (project_id, issue_type, days, n)."""
    d = metrics.cycle_time_distribution(t, project_id)
    return d.groupBy("project_id", "issue_type", F.col("cycle_days").cast(DAYS).alias("days")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(parts: DataFrame, by: tuple[str, ...] = ("project_id", "issue_type")) -> DataFrame:
    """The histogram of all rows that any part counted, by coarser keys if asked."""
    return parts.groupBy(*by, "days").agg(F.sum("n").alias("n"))


def _running(hist: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``upto``: rows of the group up to and with this value; cells first, so that a long histogram is summed in parts."""
    cells = hist.withColumn("_cell", F.floor(F.col("days") * 100 / CELL))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy(*by, "_cell").agg(F.sum("n").alias("_c")).select(*(F.col(c).alias(f"_r_{c}") for c in (*by, "_cell")), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_cell").orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_within", F.sum("n").over(within))
    joined = placed.join(before, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*by, "_cell")])
    return joined.withColumn("upto", F.col("_before") + F.col("_within")).select(*by, "days", "n", "upto")


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    spread = (n * squares - total * total).cast("double")
    return F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double"))))


def statistics(hist: DataFrame, by: tuple[str, ...] = ("project_id", "issue_type")) -> DataFrame:
    """Per group: mean, percentiles with linear interpolation, sample deviation (NULL of one value) and size."""
    keys = list(by)
    hist = merge_histograms(hist, by)
    n, x = F.col("n").cast("decimal(18,0)"), F.col("days")
    totals = hist.groupBy(*keys).agg(
        F.sum("n").alias("sample_size"), F.sum(x * n).cast("decimal(38,2)").alias("_x"), F.sum(x * x * n).cast("decimal(38,4)").alias("_xx")
    )
    renamed = totals.select(*(F.col(c).alias(f"_t_{c}") for c in keys), "sample_size", "_x", "_xx")
    values = _running(hist, keys).join(renamed, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in keys])
    picked = []
    for name, p in PERCENTILES.items():
        # The places around p (n - 1), from 0; a value holds the places from upto - n to upto - 1.
        place = F.lit(p) * (F.col("sample_size") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            picked.append(F.max(F.when(here, F.col("days"))).cast("double").alias(f"_{name}_{side}"))
        picked.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    one = [F.max(c).alias(c) for c in ("sample_size", "_x", "_xx")]
    per = values.groupBy(*keys).agg(*picked, *one)
    size = F.col("sample_size").cast("decimal(18,0)")
    out = [
        F.round(F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part"), 2).alias(name) for name in PERCENTILES
    ]
    return per.select(
        *keys, F.round(F.col("_x").cast("double") / F.col("sample_size"), 2).alias("mean_days"), *out,
        F.round(_deviation(size, F.col("_x"), F.col("_xx")), 2).alias("stddev_days"), "sample_size",
    )


def cycle_time_by_type(t: Tables, project_id: int | None = None) -> DataFrame:
    """Cycle-time statistics of each project and issue type."""
    return statistics(cycle_histogram(t, project_id))


# A4 in pages

PAGE = 100
DETAIL = ("jira_issue_id", "summary", "issue_type", "priority", "status", "story_points", "assignee_email", "created_at_jira")


def scope_creep_pages(t: Tables, project_id: int | None = None, limit: int = 5, page_size: int = PAGE) -> DataFrame:
    """Rows (project_id, sprint_id, page, next_page, issues): the issues added mid-sprint, ``page_size`` to a page.

    Issues are numbered by creation (unknown last), then key, by the skew-safe
    ranking, so a page is the same whichever page is asked for, and a list
    never holds more than a page. ``next_page`` is NULL on a sprint's last page.
    """
    detail = metrics.scope_creep_detail(t, project_id, limit)
    created = F.col("created_at_jira")
    order = [created.asc_nulls_last(), F.col("jira_issue_id").asc()]
    levels = [[(F.substring(created, 1, 10), True)], [(F.substring(created, 1, 16), True)], [(created, True)]]
    ranked = row_number_by_group(detail, "sprint_id", order, levels)
    row = F.struct("idx", F.struct(*DETAIL).alias("issue"))
    pages = ranked.withColumn("page", F.floor((F.col("idx") - 1) / page_size)).groupBy("project_id", "sprint_id", "page").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    last = ranked.groupBy("sprint_id").agg(F.floor((F.count("*") - 1) / page_size).alias("_last"))
    joined = pages.join(last, "sprint_id")
    return joined.select(
        "project_id", "sprint_id", "page", F.when(F.col("page") < F.col("_last"), F.col("page") + 1).alias("next_page"),
        F.transform("_rows", lambda r: r["issue"]).alias("issues"),
    )
