"""Registered queries: name → ``(spark, sf_dir) -> DataFrame``.

Every query reads the TESTDATA tables (through the delivery adapter or
directly) over whole tables, and computes every project in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import DeliveryAnalytics, json_text, to_json_rows
from ..operators import histograms, listing, metrics, views
from ..sources.tables import Tables
from .ingest_queries import INGEST_QUERIES
from .inputs import build_silver, tables  # noqa: F401

QueryFn = Callable[[SparkSession, str], DataFrame]

DEFAULT_WINDOW = 3
DEFAULT_LIMIT = 5


class TablesQuery:
    """A registered query over delivery tables; ``of`` runs it on any tables, such as a materialised silver layer."""

    def __init__(self, fn, **params):
        self.fn, self.params, self.__name__ = fn, params, fn.__name__

    def of(self, t: Tables) -> DataFrame:
        return self.fn(t, **self.params)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(tables(spark, sf_dir))


def _metric(fn, **params) -> QueryFn:
    return TablesQuery(fn, **params)


def project_cycle_times(t: Tables, key: str, issue_type: str) -> DataFrame:
    """One project by key, one issue type: the single-project form with its optional filter."""
    return DeliveryAnalytics(t).cycle_time_distribution(key, issue_type).select("id", "jira_issue_id", "issue_type", "cycle_days")


def velocity_json(t: Tables, window: int) -> DataFrame:
    """The nested velocity record as JSON text, one project a row."""
    trend = F.transform("trend", lambda s: F.struct(s["sprint_id"].alias("sprint_id"), s["total_issues"].alias("total_issues")))
    return to_json_rows(metrics.velocity(t, None, window, nested=True).select("project_id", "sprints_analysed", trend.alias("trend")))


def health_json(t: Tables, velocity_window: int) -> DataFrame:
    """The nested health card as JSON text, NULL fields kept."""
    return json_text(metrics.delivery_health_nested(t, None, velocity_window))


def scope_creep_json(t: Tables, limit: int, page_size: int) -> DataFrame:
    """Pages of the issues added mid-sprint as JSON text, NULL fields kept."""
    return json_text(histograms.scope_creep_pages(t, None, limit, page_size))


METRIC_QUERIES: dict[str, QueryFn] = {
    "velocity_trend": _metric(metrics.velocity_trend, window=DEFAULT_WINDOW),
    "velocity_summary": _metric(metrics.velocity, window=DEFAULT_WINDOW),
    "scope_creep": _metric(metrics.scope_creep, limit=DEFAULT_LIMIT),
    "scope_creep_detail": _metric(metrics.scope_creep_detail, limit=DEFAULT_LIMIT),
    "cycle_time_distribution": _metric(metrics.cycle_time_distribution),
    "cycle_time_stats": _metric(metrics.cycle_time),
    "sprint_completion": _metric(metrics.sprint_completion, limit=DEFAULT_LIMIT),
    "backlog_readiness": _metric(metrics.backlog_readiness),
    "backlog_by_type": _metric(metrics.backlog_by_type),
    "distribution_by_type": _metric(metrics.distribution_by_type),
    "distribution_by_status": _metric(metrics.distribution_by_status),
    "delivery_health": _metric(metrics.delivery_health, velocity_window=DEFAULT_WINDOW),
    "time_tracking": _metric(metrics.time_tracking, limit=DEFAULT_LIMIT),
}


DETAIL_PAGE = 7
LOOKUP_KEY = "europe"  # resolved case-insensitively
CYCLE_TYPE = "Story"
PREFERRED_KEY = "EUROPE"  # a key that exists, and not the first by name

LISTING_QUERIES: dict[str, QueryFn] = {
    "project_list": _metric(listing.project_list),
    "project_lookup": _metric(listing.project_lookup, key=LOOKUP_KEY),
    "default_project": _metric(listing.default_project, preferred_key=PREFERRED_KEY),
    "sprint_list": _metric(listing.sprint_list),
    "sprint_order": _metric(listing.sprint_order),
    "project_cycle_times": _metric(project_cycle_times, key=LOOKUP_KEY, issue_type=CYCLE_TYPE),
    "velocity_json": _metric(velocity_json, window=DEFAULT_WINDOW),
    "project_sync_meta": _metric(listing.project_sync_meta),
    "cycle_time_by_type": _metric(histograms.cycle_time_by_type),
    "health_json": _metric(health_json, velocity_window=DEFAULT_WINDOW),
    "scope_creep_json": _metric(scope_creep_json, limit=DEFAULT_LIMIT, page_size=DETAIL_PAGE),
}

VIEW_QUERIES: dict[str, QueryFn] = {
    "sprint_predictability": _metric(views.sprint_predictability, window=views.CHART_WINDOW),
    "velocity_rag": _metric(views.velocity_rag, window=views.CHART_WINDOW),
    "sprint_short_name": _metric(views.sprint_short_name),
    "scope_creep_totals": _metric(views.scope_creep_totals, limit=DEFAULT_LIMIT),
    "worst_scope_sprint": _metric(views.worst_scope_sprint, limit=DEFAULT_LIMIT),
    "scope_creep_band": _metric(views.scope_creep_band, limit=DEFAULT_LIMIT),
    "cycle_time_scatter": _metric(views.cycle_time_scatter),
    "sprint_progress_share": _metric(views.sprint_progress_share, limit=DEFAULT_LIMIT),
    "completion_rag": _metric(views.completion_rag, limit=DEFAULT_LIMIT),
    "distribution_pivot": _metric(views.distribution_pivot),
    "distribution_type_share": _metric(views.distribution_type_share),
    "kpi_rows": _metric(views.kpi_rows, velocity_window=DEFAULT_WINDOW),
}


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    out.update(METRIC_QUERIES)
    out.update(LISTING_QUERIES)
    out.update(VIEW_QUERIES)
    out.update(INGEST_QUERIES)
    return out
