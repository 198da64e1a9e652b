"""Project and sprint listings, key lookup and the last-sync metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import iso, latest_n
from ..sources.tables import Tables
from .metrics import ProjectNotFound

PROJECT_COLUMNS = ("id", "jira_key", "name", "description", "lead_email", "board_id")


def project_list(t: Tables) -> DataFrame:
    """All projects (ordered by name by the caller; order is not a set property)."""
    return t.projects.select(*PROJECT_COLUMNS, iso("synced_at").alias("synced_at"))


def project_lookup(t: Tables, key: str) -> DataFrame:
    """Case-insensitive key match: ``jira_key = upper(key)``; zero or one row."""
    return project_list(t).filter(F.col("jira_key") == F.upper(F.lit(key)))


def resolve_project_id(t: Tables, key: str) -> int:
    """Key → id for the single-project API; raises :class:`ProjectNotFound`.

    Reads at most one row (the key is unique), so it is a point lookup, not a
    collect of a table.
    """
    row = project_lookup(t, key).select("id").limit(1).first()
    if row is None:
        raise ProjectNotFound(f"no synced project has the key '{key}'")
    return int(row["id"])


def default_project(t: Tables, preferred_key: str) -> DataFrame:
    """Preferred key if present, else the first project by name."""
    pref = F.coalesce(F.col("jira_key") == F.lit(preferred_key), F.lit(False))
    return project_list(t).orderBy(pref.desc(), F.col("name").asc_nulls_first(), F.col("id")).limit(1)


def sprint_list(t: Tables, project_id: int | None = None, state: str | None = None) -> DataFrame:
    s = t.sprints
    if project_id is not None:
        s = s.filter(F.col("project_id") == F.lit(project_id))
    if state is not None:
        s = s.filter(F.col("state") == F.lit(state))
    return s.select(
        "project_id", "id", "jira_sprint_id", "name", "state", "goal",
        iso("start_date").alias("start_date"),
        iso("end_date").alias("end_date"),
        iso("complete_date").alias("complete_date"),
    )


def sprint_order(t: Tables) -> DataFrame:
    """Place of each sprint in its project's listing: latest start first, as the API orders it."""
    ranked = latest_n(t.sprints, None, [F.col("start_date").desc_nulls_first(), F.col("id").desc()])
    return ranked.select("project_id", "id", F.col("rank").alias("position"))


def project_sync_meta(t: Tables) -> DataFrame:
    """Projects with the start time of their latest successful sync.

    The reference's correlated scalar subquery becomes one grouped aggregate
    over the run log, left-joined to projects.
    """
    last_ok = (
        t.sync_log.filter(F.col("status") == "success")
        .groupBy("project_id")
        .agg(F.max("started_at").alias("_last"))
    )
    p = t.projects.select(F.col("id").alias("project_id"), "jira_key", "name", "synced_at")
    return p.join(last_ok, "project_id", "left").select(
        "jira_key", "name", iso("synced_at").alias("synced_at"), iso("_last").alias("last_sync_ok")
    )
