"""Per-project entry points shaped like the reference's REST routes.

``DeliveryAnalytics(tables)`` resolves a project key (case-insensitive,
``ProjectNotFound`` when unknown), checks the window/limit bounds and returns
the metric as a ``DataFrame`` in the nested response shape. The same
functions in :mod:`cadence.operators.metrics` with ``project_id=None`` serve
every project in one job; this class is the single-project convenience.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import listing, metrics
from .sources.tables import Tables


def to_json_rows(df: DataFrame) -> DataFrame:
    """JSON result sink: one JSON object per row (``write.text`` it, or collect a page)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def json_text(df: DataFrame) -> DataFrame:
    """Like :func:`to_json_rows`, with NULL fields as ``null``: the shape of a REST response."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


class DeliveryAnalytics:
    def __init__(self, tables: Tables):
        self.t = tables

    def _pid(self, key: str) -> int:
        return listing.resolve_project_id(self.t, key)

    def projects(self) -> DataFrame:
        return listing.project_list(self.t).orderBy("name")

    def project(self, key: str) -> DataFrame:
        self._pid(key)
        return listing.project_lookup(self.t, key)

    def sprints(self, key: str, state: str | None = None) -> DataFrame:
        return listing.sprint_list(self.t, self._pid(key), state).orderBy(F.col("start_date").desc_nulls_first())

    def meta(self) -> DataFrame:
        return listing.project_sync_meta(self.t).orderBy("name")

    def velocity(self, key: str, window: int = 3) -> DataFrame:
        metrics.check_bound("window", window)
        return metrics.velocity(self.t, self._pid(key), window, nested=True)

    def scope_creep(self, key: str, limit: int = 5) -> DataFrame:
        metrics.check_bound("limit", limit)
        return metrics.scope_creep_nested(self.t, self._pid(key), limit).orderBy("recency_rank")

    def cycle_time(self, key: str, issue_type: str | None = None, sprint_id: int | None = None) -> DataFrame:
        return metrics.cycle_time(self.t, self._pid(key), issue_type, sprint_id)

    def cycle_time_distribution(self, key: str, issue_type: str | None = None, sprint_id: int | None = None) -> DataFrame:
        return metrics.cycle_time_distribution(self.t, self._pid(key), issue_type, sprint_id).orderBy(
            F.col("done_at").desc_nulls_first(), "id"
        )

    def sprint_completion(self, key: str, limit: int = 5) -> DataFrame:
        metrics.check_bound("limit", limit)
        return metrics.sprint_completion(self.t, self._pid(key), limit).orderBy("recency_rank")

    def backlog(self, key: str) -> DataFrame:
        pid = self._pid(key)
        by_type = metrics.backlog_by_type(self.t, pid).groupBy("project_id").agg(
            F.collect_list(F.struct("issue_type", "count")).alias("by_issue_type")  # ≤ 3 types
        )
        out = metrics.backlog_readiness(self.t, pid).join(by_type, "project_id", "left")
        return out.withColumn("by_issue_type", F.coalesce("by_issue_type", F.array()))

    def distribution(self, key: str, sprint_id: int | None = None) -> tuple[DataFrame, DataFrame]:
        pid = self._pid(key)
        return (
            metrics.distribution_by_status(self.t, pid, sprint_id).orderBy("status_category"),
            metrics.distribution_by_type(self.t, pid, sprint_id).orderBy("status_category", "issue_type"),
        )

    def health(self, key: str, window: int = 3) -> DataFrame:
        metrics.check_bound("window", window)
        return metrics.delivery_health_nested(self.t, self._pid(key), window)

    def time_tracking(self, key: str, limit: int = 5) -> DataFrame:
        metrics.check_bound("limit", limit, hi=None)
        return metrics.time_tracking(self.t, self._pid(key), limit).orderBy(F.col("recency_rank").desc())
