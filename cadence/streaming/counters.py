"""Counters of the delivery metrics, kept up to date by signed deltas.

A merge changes some issues. Each contributes +1 and its points to the cell of
its new state and -1 and its points to the cell of its state before, if it had
one; cells are (project, sprint, type, status, category, mid-sprint, has
criteria, estimated). The sum of the deltas of all committed batches is what
grouping all issues would give, without reading them: sprint counters
(velocity, scope creep, completion), the backlog's and the distributions' are
sums of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.metrics import BACKLOG_TYPES, DONE, IN_PROGRESS, TO_DO
from . import store as S

CELL = ("project_key", "sprint_id", "issue_type", "status", "status_category", "mid", "has_ac", "estimated")
DELTA_SCHEMA = (
    "project_key string, sprint_id long, issue_type string, status string, status_category string, "
    "mid boolean, has_ac boolean, estimated boolean, n long, points decimal(38,1)"
)


def cells(state: DataFrame, starts: DataFrame, sign: int = 1) -> DataFrame:
    """The cells of issue states, counted ``sign`` each; ``starts`` is (sprint_id, sprint_start).

    Points are those of the silver table: imputed where there are none or time was logged.
    """
    placed = state.join(starts, "sprint_id", "left")
    rows = placed.select(
        *CELL[:5], X.added_mid_sprint("last_created", "sprint_start").alias("mid"), F.coalesce("has_ac", F.lit(False)).alias("has_ac"),
        X.impute_points(F.col("story_points"), F.col("time_spent"), F.col("original_estimate")).alias("sp"),
    ).withColumn("estimated", F.col("sp").isNotNull())
    return rows.groupBy(*CELL).agg((F.count("*") * sign).alias("n"), F.sum(F.col("sp") * sign).cast("decimal(38,1)").alias("points"))


def deltas(before: DataFrame, after: DataFrame, keys: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """What the merge of the issues ``keys`` changes; cells that stay as they were give no row."""
    of = keys.select(key).distinct()
    both = cells(after.join(of, key, "left_semi"), starts).unionByName(cells(before.join(of, key, "left_semi"), starts, -1))
    return total(both)


def total(parts: DataFrame) -> DataFrame:
    """The sum of cells and deltas, empty cells left out."""
    return parts.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("points").cast("decimal(38,1)").alias("points")).where("n <> 0 or points <> 0")


def read(spark: SparkSession, store: str) -> DataFrame:
    """The committed counters, by cell."""
    rows = S.committed_rows(spark, store, "counters", DELTA_SCHEMA)
    return total(spark.createDataFrame([], DELTA_SCHEMA) if rows is None else rows.drop("batch", "bucket"))


def _sums(counted: DataFrame, *by: str) -> DataFrame:
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    points = lambda cond: F.sum(F.when(cond, F.col("points")).otherwise(0)).cast("double").alias
    every, category = F.lit(True), F.col("status_category")
    return counted.groupBy(*by).agg(
        n(every)("total_issues"), n(category == DONE)("done_issues"), n(F.col("mid"))("added_issues"), n(~F.col("mid"))("original_issues"),
        points(category == DONE)("completed_points"), points(~F.col("mid"))("committed_points"), points(F.col("mid"))("added_points"),
        points(every)("total_points"), points(category == IN_PROGRESS)("in_progress_points"), points(category == TO_DO)("todo_points"),
        n(F.col("has_ac"))("with_criteria"), n(F.col("estimated"))("estimated_issues"),
    )


def sprint_counters(counted: DataFrame) -> DataFrame:
    """Per project and sprint: the counters of velocity, scope creep and completion."""
    return _sums(counted.where("sprint_id is not null"), "project_key", "sprint_id")


def backlog_counters(counted: DataFrame) -> DataFrame:
    """Per project and type: the open issues without a sprint."""
    return _sums(counted.where("sprint_id is null").where((F.col("status_category") != DONE) & F.col("issue_type").isin(*BACKLOG_TYPES)), "project_key", "issue_type")


def status_counters(counted: DataFrame) -> DataFrame:
    """Per project, type and status: the point distribution."""
    return _sums(counted, "project_key", "issue_type", "status")
