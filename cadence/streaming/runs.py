"""Run life cycle: a ``running`` row before the work, ``success`` or ``failed`` with a message after it.

The log is append-only, one small file an event. A run is (batch, pull,
project); its last event is its state, so a run that fails and is retried ends
as a success, and one whose driver died stays ``running``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync
from ..sources.tables import Tables, load_tables, write_tables
from . import store as S

EVENT_SCHEMA = "batch long, pull long, jira_key string, status string, at timestamp, message string, issues long, sprints long"
MESSAGE_CHARS = 2_000


def _now() -> datetime:
    return datetime.now(timezone.utc)


def record(spark: SparkSession, named: list[tuple], log: str, batch: int, status: str, message: str | None = None) -> None:
    """Append an event of each run of ``named``: (pull, jira_key, issues, sprints)."""
    message, at = message[:MESSAGE_CHARS] if message else None, _now()
    rows = [(batch, pull, key, status, at, message, issues, sprints) for pull, key, issues, sprints in named]
    S.literal_rows(spark, rows, EVENT_SCHEMA).write.mode("append").parquet(log)


@contextmanager
def logged(spark: SparkSession, log: str, batch: int, runs: Callable[[], list[tuple]]) -> Iterator[None]:
    """Log the work of the ``with`` block; an error is logged and raised again.

    ``runs`` names the runs, (pull, jira_key, issues, sprints), before the
    work: a row for each project and pull of a batch. Where even that fails,
    the run has no project.
    """
    named: list[tuple] = [(None, None, None, None)]
    try:
        named = runs()
        if named:
            record(spark, [(p, k, None, None) for p, k, _, _ in named], log, batch, "running")
        yield
        if named:
            record(spark, named, log, batch, "success")
    except Exception as error:
        record(spark, [(p, k, None, None) for p, k, _, _ in named], log, batch, "failed", f"{type(error).__name__}: {error}")
        raise


def states(spark: SparkSession, log: str) -> DataFrame:
    """Rows (batch, pull, jira_key, status, message, issues, sprints, started_at, finished_at): the last event of each run."""
    events = S.read(spark, log, EVENT_SCHEMA)
    if events is None:
        events = spark.createDataFrame([], EVENT_SCHEMA)
    order = F.struct("at", (F.col("status") != "running").alias("ended"))
    last = F.max_by(F.struct("status", "message", "issues", "sprints"), order)
    ended = F.max(F.when(F.col("status") != "running", F.col("at")))
    started = F.max(F.when(F.col("status") == "running", F.col("at")))
    by = events.groupBy("batch", "pull", "jira_key").agg(last.alias("last"), started.alias("started_at"), ended.alias("finished_at"))
    return by.select("batch", "pull", "jira_key", "last.*", "started_at", F.when(F.col("last.status") != "running", F.col("finished_at")).alias("finished_at"))


def sync_log(states: DataFrame, keys: DataFrame, sync_type: str = "incremental") -> DataFrame:
    """The run log of the delivery tables: a row for each project and pull, however its batches were cut.

    A pull has failed while a batch of it has failed, and runs while one does;
    it finishes with its last batch. ``keys`` is (project_id, jira_key); a run
    that failed before its project was read is in ``states`` alone.
    """
    named = states.join(keys, "jira_key")
    failed, running = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status") == "running")
    by = named.groupBy("project_id", "pull").agg(
        F.when(failed, "failed").when(running, "running").otherwise("success").alias("status"),
        F.sum(F.when(F.col("status") == "success", F.coalesce("issues", F.lit(0))).otherwise(0)).alias("issues_synced"),
        F.sum(F.when(F.col("status") == "success", F.coalesce("sprints", F.lit(0))).otherwise(0)).alias("sprints_synced"),
        F.max(F.when(F.col("status") == "failed", F.col("message"))).alias("error_message"),
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
    )
    return by.select(
        F.xxhash64("project_id", "pull").alias("id"), "project_id", F.lit(sync_type).alias("sync_type"), "status", "issues_synced", "sprints_synced",
        "error_message", "started_at", F.when(F.col("status") != "running", F.col("finished_at")).alias("finished_at"),
    )


def log_dir(store: str) -> str:
    return os.path.join(store, "log")


def sync_logged(spark: SparkSession, landing: str, target: str, log: str, run: int, jira_keys: list[str], **options) -> Tables:
    """One pull's batch sync into the table folder ``target``, logged from its start to its end.

    The projects ``jira_keys`` are marked as running before anything is read;
    an error leaves them as failed, with its message, and is raised again.
    """
    found: list[tuple] = [(run, key, None, None) for key in jira_keys]
    with logged(spark, log, run, lambda: found):
        out = sync.sync_batch(spark, landing, **options)
        write_tables(out, target)
        out = load_tables(spark, target)
        keys = out.projects.select(F.col("id").alias("project_id"), "jira_key")
        counted = out.sync_log.join(keys, "project_id").groupBy("jira_key").agg(F.sum("issues_synced").alias("issues"), F.sum("sprints_synced").alias("sprints"))
        counts = {r.jira_key: (r.issues, r.sprints) for r in counted.where(F.col("jira_key").isin(jira_keys)).collect()}
        found[:] = [(run, key, *counts.get(key, (0, 0))) for key in jira_keys]
    return out
