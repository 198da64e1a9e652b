"""Query name → oracle SQL (DuckDB), matching :mod:`cadence.plans.catalog`."""

from __future__ import annotations

from . import oracle as o
from ..operators.views import CHART_WINDOW
from .ingest_queries import DOC_AC_MARKERS
from .catalog import CYCLE_TYPE, DEFAULT_LIMIT, DEFAULT_WINDOW, DETAIL_PAGE, LOOKUP_KEY, PREFERRED_KEY


def oracle_sql() -> dict[str, str]:
    return {
        "velocity_trend": o.velocity_trend(DEFAULT_WINDOW),
        "velocity_summary": o.velocity_summary(DEFAULT_WINDOW),
        "scope_creep": o.scope_creep(DEFAULT_LIMIT),
        "scope_creep_detail": o.scope_creep_detail(DEFAULT_LIMIT),
        "cycle_time_distribution": o.cycle_time_distribution(),
        "cycle_time_stats": o.cycle_time_stats(),
        "sprint_completion": o.sprint_completion(DEFAULT_LIMIT),
        "backlog_readiness": o.backlog_readiness(),
        "backlog_by_type": o.backlog_by_type(),
        "distribution_by_type": o.distribution_by_type(),
        "distribution_by_status": o.distribution_by_status(),
        "delivery_health": o.delivery_health(DEFAULT_WINDOW),
        "time_tracking": o.time_tracking(DEFAULT_LIMIT),
        "project_list": o.project_list(),
        "project_lookup": o.project_lookup(LOOKUP_KEY),
        "default_project": o.default_project(PREFERRED_KEY),
        "sprint_list": o.sprint_list(),
        "project_sync_meta": o.project_sync_meta(),
        "sprint_predictability": o.sprint_predictability(CHART_WINDOW),
        "velocity_rag": o.velocity_rag(CHART_WINDOW),
        "sprint_short_name": o.sprint_short_name(),
        "scope_creep_totals": o.scope_creep_totals(DEFAULT_LIMIT),
        "worst_scope_sprint": o.worst_scope_sprint(DEFAULT_LIMIT),
        "scope_creep_band": o.scope_creep_band(DEFAULT_LIMIT),
        "cycle_time_scatter": o.cycle_time_scatter(),
        "sprint_progress_share": o.sprint_progress_share(DEFAULT_LIMIT),
        "completion_rag": o.completion_rag(DEFAULT_LIMIT),
        "distribution_pivot": o.distribution_pivot(),
        "distribution_type_share": o.distribution_type_share(),
        "kpi_rows": o.kpi_rows(DEFAULT_WINDOW),
        "project_cycle_times": o.project_cycle_times(LOOKUP_KEY, CYCLE_TYPE),
        "velocity_json": o.velocity_json(DEFAULT_WINDOW),
        "sprint_order": o.sprint_order(),
        "history_append": o.history_append(),
        "sync_roundtrip": o.sync_roundtrip(),
        "two_pull_sync": o.two_pull_sync(),
        "quarantine_counts": o.quarantine_counts(),
        "has_ac_flag": o.has_ac_flag(),
        "added_mid_sprint": o.added_mid_sprint(),
        "parse_timestamps": o.parse_timestamps(),
        "story_points_parse": o.story_points_parse(),
        "story_point_impute": o.story_point_impute(),
        "acceptance_criteria": o.acceptance_criteria(DOC_AC_MARKERS),
        "rich_text_extract": o.rich_text_extract(),
        "rich_text_exact": o.rich_text_exact(),
        "transition_dates": o.transition_dates(),
        "status_history": o.status_history(),
        "project_upsert": o.project_upsert(),
        "sprint_upsert": o.sprint_upsert(),
        "issue_upsert": o.issue_upsert(),
        "issue_batch_collapse": o.issue_batch_collapse(),
        "sync_run_summary": o.sync_run_summary(),
        "constraint_audit": o.constraint_audit(),
        "incremental_ingest": o.incremental_ingest(),
        "cycle_time_by_type": o.cycle_time_by_type(),
        "health_json": o.health_json(DEFAULT_WINDOW),
        "scope_creep_json": o.scope_creep_json(DEFAULT_LIMIT, DETAIL_PAGE),
        "issue_upsert_stamps": o.issue_upsert_stamps(),
        "stream_counters": o.stream_counters(),
        "stream_repair": o.stream_repair(),
        "run_life_cycle": o.run_life_cycle(),
        "page_completeness": o.page_completeness(),
    }
