"""Silver layer: landed issue documents → clean delivery rows.

All steps are column expressions or grouped aggregates with partial
aggregation; change logs are read with higher-order functions inside each
document, never by gathering an issue's whole history in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.expr import has_ac, iso
from ..sources.schemas import POINTS


def _status_items(changelog: Column) -> Column:
    """``array<struct<ts, to, raw_to, from>>`` of status items in encounter order."""
    return F.flatten(
        F.transform(
            changelog["histories"],
            lambda h: F.transform(
                F.filter(h["items"], lambda i: i["field"] == "status"),
                lambda i: F.struct(
                    X.parse_ts(h["created"]).alias("ts"),
                    F.lower(F.coalesce(i["toString"], F.lit(""))).alias("to"),
                ),
            ),
        )
    )


def transition_dates(changelog: Column, order: str = "encounter") -> tuple[Column, Column]:
    """First "in progress" and first done/closed/resolved instants of one document.

    ``order="encounter"`` follows change-log order (the reference's rule);
    ``order="time"`` takes the earliest instant instead. Items whose time
    does not parse are skipped.
    """
    items = F.filter(_status_items(changelog), lambda x: x["ts"].isNotNull())
    ip = F.filter(items, lambda x: x["to"].contains(X.IN_PROGRESS_MARK))
    done = F.filter(items, lambda x: x["to"].isin(*X.DONE_STATUSES))
    if order == "time":
        first = lambda arr: F.array_min(F.transform(arr, lambda x: x["ts"]))
    elif order == "encounter":
        first = lambda arr: F.try_element_at(arr, F.lit(1))["ts"]
    else:
        raise ValueError("order must be 'encounter' or 'time'")
    return first(ip), first(done)


def transition_dates_by_issue(pages: DataFrame, key: str = "issue_id", page: str = "page", order: str = "encounter") -> DataFrame:
    """Combine per-page first transitions across change-log pages of an issue.

    Each page contributes its own first instants; the issue's value is the one
    from the earliest page that has one (``min_by`` skips NULL order keys).
    Partial aggregation keeps a hot issue from landing in one task.
    """
    ip, done = transition_dates(F.col("changelog"), order)
    per_page = pages.select(key, page, ip.alias("_ip"), done.alias("_done"))
    if order == "time":
        agg = [F.min("_ip").alias("in_progress_at"), F.min("_done").alias("done_at")]
    else:
        agg = [
            F.min_by("_ip", F.when(F.col("_ip").isNotNull(), F.col(page))).alias("in_progress_at"),
            F.min_by("_done", F.when(F.col("_done").isNotNull(), F.col(page))).alias("done_at"),
        ]
    return per_page.groupBy(key).agg(*agg)


def status_history(pages: DataFrame, key: str = "issue_id") -> DataFrame:
    """One row per status item, de-duplicated on the natural key (insert-if-absent)."""
    h = pages.select(key, F.explode("changelog.histories").alias("h"))
    it = h.select(key, "h.created", F.col("h.author.emailAddress").alias("author_email"), F.explode("h.items").alias("i"))
    rows = it.filter(F.col("i.field") == "status").select(
        F.col(key).alias("issue_id"),
        F.col("i.fromString").alias("from_status"),
        F.col("i.toString").alias("to_status"),
        X.parse_ts(F.col("created")).alias("transitioned_at"),
        "author_email",
    )
    return rows.dropDuplicates(["issue_id", "from_status", "to_status", "transitioned_at", "author_email"])


def append_history(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``INSERT … ON CONFLICT DO NOTHING`` on the natural key: only new rows are appended."""
    k = ["issue_id", "from_status", "to_status", "transitioned_at", "author_email"]
    # NULL-safe equality: a NULL time or author still identifies the same row.
    return incoming.dropDuplicates(k).alias("n").join(
        existing.select(*k).alias("e"),
        on=[F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in k],
        how="left_anti",
    )


def normalize(
    docs: DataFrame,
    story_points_field: str = "story_points",
    ac_field: str = "acceptance_criteria",
    ac_markers: tuple[str, ...] = X.AC_MARKERS,
    context: tuple[str, ...] = ("project_id", "sprint_id"),
) -> DataFrame:
    """Flatten issue documents to silver issue rows (one row per document).

    ``docs`` carries ``key, fields, changelog``, a sequence column ``seq`` and
    the ``context`` columns, which pass through. ``added_mid_sprint`` is
    computed when ``docs`` has a ``sprint_start``.
    Missing nested parents give NULL, as struct access does.
    """
    f = F.col("fields")
    description = X.extract_text_exact(f["description"])
    ip, done = transition_dates(F.col("changelog"))
    created = X.parse_ts(f["created"])
    ac = X.acceptance_criteria(f[ac_field], description, ac_markers)
    source_id = [F.col("id")] if "id" in docs.columns else []
    return docs.select(
        *source_id,
        F.col("key").alias("jira_issue_id"),
        *context,
        "seq",
        f["issuetype"]["name"].alias("issue_type"),
        f["priority"]["name"].alias("priority"),
        f["status"]["name"].alias("status"),
        f["status"]["statusCategory"]["name"].alias("status_category"),
        f["summary"].alias("summary"),
        description.alias("description"),
        ac.alias("acceptance_criteria"),
        has_ac(ac).alias("has_ac"),
        X.story_points(f[story_points_field], f["story_points"]).try_cast(POINTS).alias("story_points"),
        f["timeoriginalestimate"].alias("original_estimate"),
        f["timespent"].alias("time_spent"),
        f["timeestimate"].alias("remaining_estimate"),
        f["assignee"]["emailAddress"].alias("assignee_email"),
        f["reporter"]["emailAddress"].alias("reporter_email"),
        created.alias("created_at_jira"),
        X.parse_ts(f["updated"]).alias("updated_at_jira"),
        ip.alias("in_progress_at"),
        done.alias("done_at"),
        X.parse_ts(f["duedate"]).cast("date").alias("due_date"),
        *([X.added_mid_sprint(created, F.col("sprint_start")).alias("added_mid_sprint")] if "sprint_start" in docs.columns else []),
    )


def unstorable_points(docs: DataFrame, story_points_field: str = "story_points") -> DataFrame:
    """Documents whose story points are a number that the table's type cannot hold (they become NULL)."""
    f = F.col("fields")
    points = X.story_points(f[story_points_field], f["story_points"])
    return docs.where(points.isNotNull() & points.try_cast(POINTS).isNull()).select("key", points.alias("story_points"))


def impute_story_points(issues: DataFrame) -> DataFrame:
    """Whole-table imputation pass (the last projection of the silver table)."""
    return issues.withColumn(
        "story_points", X.impute_points(F.col("story_points"), F.col("time_spent"), F.col("original_estimate"))
    )


def iso_cols(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, iso(c))
    return df
