"""Batch sync: landed documents (bronze) → silver delivery tables.

The reference's sync loops project → boards → sprints → issues, one REST
call and one database transaction per issue. Here the pull has already
landed JSON (project docs, board pages, sprint pages, issue pages tagged with
the project and sprint they were pulled for) and one Spark job does:

1. projects: upsert on ``jira_key``; ``board_id`` ← first landed board;
2. sprints: project key → id (join), upsert on ``jira_sprint_id``;
3. issues: flatten pages, normalise documents, collapse the batch (later
   sprint wins, sticky dates keep the first non-NULL), join project and
   sprint start, merge into the current table, then impute story points
   table-wide;
4. status history: explode change logs, append only unseen rows;
5. run log: one row per synced project with issue/sprint counts.

Every step is a join or grouped aggregate keyed by project, sprint or
issue; the small project/sprint frames are broadcast by AQE only when their
measured size is under the threshold.
"""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources import landed, schemas
from ..sources.tables import Tables, empty
from . import silver, upsert

LANDING_PARTS = ("projects", "boards", "sprints", "issues")
PULL = T.StructField("pull", T.LongType())
#: Issue pages of a landed file, which one task reads.
ISSUES_PER_FILE = 100_000
CORRUPT = T.StructField(landed.CORRUPT, T.StringType())

# Column classes while the keys are still those of the documents: projects by
# key, and the creation time of the version whose sprint counts.
SPRINT_DOCS = replace(upsert.SPRINT_SPEC, insert_only=("id", "project_key"))
ISSUE_DOCS = replace(
    upsert.ISSUE_SPEC,
    overwrite=(*(c for c in upsert.ISSUE_SPEC.overwrite if c not in ("added_mid_sprint", "synced_at")), "last_created"),
    insert_only=tuple("project_key" if c == "project_id" else c for c in upsert.ISSUE_SPEC.insert_only),
)


def _part_schemas(story_points_field: str, ac_field: str) -> dict[str, T.StructType]:
    return {
        "projects": T.StructType([*schemas.PROJECT_DOC.fields, PULL, CORRUPT]),
        "boards": landed.envelope_schema(schemas.BOARD_DOC),
        "sprints": landed.envelope_schema(schemas.SPRINT_DOC),
        "issues": landed.envelope_schema(schemas.issue_doc(story_points_field, ac_field)),
    }


def read_landing(spark: SparkSession, landing: str, story_points_field: str = "story_points",
                 ac_field: str = "acceptance_criteria") -> dict[str, DataFrame]:
    read = {part: landed.read_json(spark, os.path.join(landing, part), schema) for part, schema in _part_schemas(story_points_field, ac_field).items()}
    pull = F.coalesce(F.col("pull"), F.lit(0).cast("long"))
    # Documents of one file have no position; equal ones are told apart by content.
    tie = F.xxhash64("id", "key", "name", "description", "lead.emailAddress")
    projects = read["projects"].where(F.col(landed.CORRUPT).isNull() & F.col("key").isNotNull()).withColumn("pull", pull)
    projects = projects.withColumn("seq", F.struct("pull", F.col("seq_file").alias("file"), tie.alias("tie")))
    return {"projects": projects, **{part: landed.flatten_pages(read[part]) for part in ("boards", "sprints", "issues")}}


def quarantined(spark: SparkSession, landing: str) -> DataFrame:
    """Landed lines that did not parse, kept for repair: (part, seq_file, record)."""
    out = None
    for part, schema in _part_schemas("story_points", "acceptance_criteria").items():
        bad = landed.quarantine(landed.read_json(spark, os.path.join(landing, part), schema)).select(F.lit(part).alias("part"), "seq_file", "record")
        out = bad if out is None else out.unionByName(bad)
    return out


def document_rows(flat: DataFrame, story_points_field: str = "story_points", ac_field: str = "acceptance_criteria") -> DataFrame:
    """Flattened issue documents → narrow issue rows, keyed by project key and sprint id."""
    docs = flat.select(
        "id", "key", "fields", "changelog", "seq", F.col("projectKey").alias("project_key"), F.col("sprintId").alias("sprint_id"),
        X.parse_ts(F.col("fields.created")).alias("last_created"),
    )
    rows = silver.normalize(docs, story_points_field, ac_field, context=("project_key", "sprint_id", "last_created"))
    return rows.withColumn("id", F.col("id").cast("long"))


def resolve(rows: DataFrame, keys: DataFrame, sprints: DataFrame) -> DataFrame:
    """Project ids and the mid-sprint flag, joined to collapsed (narrow) issue rows.

    Backlog rows have no sprint; they meet no row of the sprint join and are
    dealt by their own key, so they do not meet in one partition either.
    """
    starts = sprints.select(F.col("id").alias("_sprint"), F.col("start_date").alias("sprint_start"))
    dealt = F.coalesce(F.col("sprint_id"), F.xxhash64(ISSUE_DOCS.key))
    placed = rows.join(starts, (dealt == F.col("_sprint")) & F.col("sprint_id").isNotNull(), "left").drop("_sprint")
    named = placed.join(keys.withColumnRenamed("jira_key", "project_key"), "project_key", "left")
    return named.withColumn("added_mid_sprint", X.added_mid_sprint("last_created", "sprint_start")).drop("sprint_start", "project_key", "last_created")


def run_log(project_docs: DataFrame, issue_docs: DataFrame, sprint_docs: DataFrame, keys: DataFrame, as_of: Column, full: bool = False) -> DataFrame:
    """One row for each synced project and pull, also for projects without issues or sprints.

    ``project_docs`` has (pull, jira_key), the others (pull, projectKey).
    Issues count upsert calls (a document seen twice counts twice); sprints
    count the sprint documents, including sprints without issues.
    """
    runs = project_docs.select("pull", "jira_key").distinct()
    for docs, name in ((issue_docs, "issues_synced"), (sprint_docs, "sprints_synced")):
        counts = docs.groupBy("pull", F.col("projectKey").alias("jira_key")).agg(F.count(F.lit(1)).alias(name))
        runs = runs.join(counts, ["pull", "jira_key"], "left")
    return runs.join(keys, "jira_key").select(
        F.xxhash64("project_id", "pull", as_of.cast("string")).alias("id"), "project_id",
        F.lit("full" if full else "incremental").alias("sync_type"), F.lit("success").alias("status"),
        F.coalesce("issues_synced", F.lit(0)).cast("long").alias("issues_synced"),
        F.coalesce("sprints_synced", F.lit(0)).cast("long").alias("sprints_synced"),
        F.lit(None).cast("string").alias("error_message"), as_of.alias("started_at"), as_of.alias("finished_at"),
    )


def sync_batch(
    spark: SparkSession,
    landing: str,
    current: Tables | None = None,
    as_of: Column | None = None,
    story_points_field: str = "story_points",
    ac_field: str = "acceptance_criteria",
    impute: bool = True,
    observation: Observation | None = None,
    full: bool = False,
    bronze: str | None = None,
) -> Tables:
    """Merge everything landed under ``landing`` into ``current`` (or an empty silver layer).

    Landing order (pull, page, file, position) decides which version of a
    project, sprint or issue is the last; any number of pulls may be landed.
    Pass an ``Observation`` to get the run's totals (issue documents upserted
    and how many came from sprint pages) from the first job that writes the
    result, without a separate counting job. ``bronze`` names a new folder
    for the parsed issue documents, so that the three readers of them (rows,
    history, log) do not parse the landed text again. ``as_of`` is one instant
    for the whole batch; by default the driver's time now.
    """
    as_of = as_of if as_of is not None else F.lit(datetime.now(timezone.utc))
    src = read_landing(spark, landing, story_points_field, ac_field)
    if observation is not None:
        src["issues"] = src["issues"].observe(
            observation,
            F.count(F.lit(1)).alias("issue_documents"),
            F.count("sprintId").alias("sprint_issue_documents"),
        )
    if bronze is not None:
        # ``seq`` holds the file, page and position.
        src["issues"] = src["issues"].drop("seq_file", "seq_page", "seq_pos")
        src["issues"].write.parquet(bronze)
        src["issues"] = spark.read.schema(src["issues"].schema).parquet(bronze)
    cur = current or Tables(
        projects=empty(spark, schemas.PROJECTS), sprints=empty(spark, schemas.SPRINTS),
        issues=empty(spark, schemas.ISSUES), status_history=empty(spark, schemas.STATUS_HISTORY),
        sync_log=empty(spark, schemas.SYNC_LOG),
    )

    # 1. projects (+ first board of the last pull that landed boards)
    incoming_p = src["projects"].select(
        F.col("id").cast("long").alias("id"), F.col("key").alias("jira_key"), "name", "description",
        F.col("lead.emailAddress").alias("lead_email"), F.col("id").cast("string").alias("jira_project_id"),
        as_of.alias("synced_at"), "seq",
    )
    projects = upsert.upsert(cur.projects, incoming_p, upsert.PROJECT_SPEC, as_of=as_of)
    first_board = src["boards"].groupBy(F.col("projectKey").alias("jira_key")).agg(
        F.min_by("id", F.struct((-F.col("pull")).alias("newest"), "seq")).alias("_board")
    )
    projects = projects.join(first_board, "jira_key", "left").withColumn(
        "board_id", F.coalesce(F.col("_board"), F.col("board_id"))
    ).drop("_board")
    keys = projects.select(F.col("id").alias("project_id"), "jira_key")

    # 2. sprints: collapsed first, then joined to their project
    sprint_rows = src["sprints"].select(
        F.col("id").alias("id"), F.col("id").alias("jira_sprint_id"), F.col("projectKey").alias("project_key"), "name", "state", "goal",
        X.parse_ts(F.col("startDate")).alias("start_date"), X.parse_ts(F.col("endDate")).alias("end_date"),
        X.parse_ts(F.col("completeDate")).alias("complete_date"), as_of.alias("synced_at"), "seq",
    )
    incoming_s = upsert.collapse_batch(sprint_rows, SPRINT_DOCS).drop("seq")
    incoming_s = incoming_s.join(keys.withColumnRenamed("jira_key", "project_key"), "project_key").drop("project_key")
    sprints = upsert.merge(cur.sprints, incoming_s, upsert.SPRINT_SPEC, as_of=as_of)

    # 3. issues: normalised and collapsed first; documents and change logs never reach a join
    flat = src["issues"]
    # An issue has few documents in a batch: its rows are shuffled as they are and sorted once, where
    # combining them first would sort them twice and shuffle a sequence for each column class.
    documents = document_rows(flat, story_points_field, ac_field).repartition(ISSUE_DOCS.key)
    collapsed = upsert.collapse_batch(documents, ISSUE_DOCS).drop("seq")
    rows = resolve(collapsed, keys, sprints).withColumn("synced_at", as_of)
    issues = upsert.merge(cur.issues, rows, upsert.ISSUE_SPEC, as_of=as_of)
    if impute:
        issues = silver.impute_story_points(issues)

    # 4. status history (insert-if-absent on the natural key)
    ids = flat.select(F.col("id").cast("long").alias("issue_id"), "changelog")
    new_hist = silver.append_history(cur.status_history, silver.status_history(ids))
    history = cur.status_history.unionByName(new_hist)

    # 5. run log
    run = run_log(src["projects"].select("pull", F.col("key").alias("jira_key")), flat, src["sprints"], keys, as_of, full)
    sync_log = cur.sync_log.unionByName(run)
    return Tables(projects=projects, sprints=sprints, issues=issues, status_history=history, sync_log=sync_log)


# ── landing writer (renders silver-shaped tables as landed documents) ────────

def _doc_ts(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSZ")


def land_tables(t: Tables, landing: str, pull: int = 0) -> None:
    """Write tables as the documents that pull number ``pull`` would land (for tests and replays)."""
    p = lambda root, part: os.path.join(root, part, f"pull={pull}")
    t.projects.select(
        F.col("id").cast("string").alias("id"), F.col("jira_key").alias("key"), "name", "description",
        F.struct(F.col("lead_email").alias("emailAddress")).alias("lead"),
    ).write.mode("overwrite").json(p(landing, "projects"))
    t.projects.filter(F.col("board_id").isNotNull()).select(
        F.lit(0).cast("long").alias("page"), F.col("jira_key").alias("projectKey"),
        F.array(F.struct(F.col("board_id").alias("id"), F.lit("board").alias("name"), F.lit("scrum").alias("type"))).alias("values"),
    ).write.mode("overwrite").json(p(landing, "boards"))
    keys = t.projects.select(F.col("id").alias("project_id"), F.col("jira_key").alias("projectKey"))
    t.sprints.join(keys, "project_id").select(
        F.col("id").alias("page"), "projectKey",
        F.array(F.struct(
            F.col("jira_sprint_id").alias("id"), "name", "state", "goal",
            _doc_ts(F.col("start_date")).alias("startDate"), _doc_ts(F.col("end_date")).alias("endDate"),
            _doc_ts(F.col("complete_date")).alias("completeDate"),
        )).alias("values"),
    ).write.mode("overwrite").json(p(landing, "sprints"))
    item = lambda ts, to: F.when(
        ts.isNotNull(),
        F.struct(_doc_ts(ts).alias("created"), F.struct(F.lit(None).cast("string").alias("emailAddress")).alias("author"),
                 F.array(F.struct(F.lit("status").alias("field"), F.lit(None).cast("string").alias("fromString"),
                                  F.lit(to).alias("toString"))).alias("items")),
    )
    name = lambda c: F.struct(F.col(c).alias("name"))
    fields = F.struct(
        "summary", "description", name("issue_type").alias("issuetype"), name("priority").alias("priority"),
        F.struct(F.col("status").alias("name"), name("status_category").alias("statusCategory")).alias("status"),
        F.struct(F.col("assignee_email").alias("emailAddress")).alias("assignee"),
        F.struct(F.col("reporter_email").alias("emailAddress")).alias("reporter"),
        _doc_ts(F.col("created_at_jira")).alias("created"), _doc_ts(F.col("updated_at_jira")).alias("updated"),
        F.date_format("due_date", "yyyy-MM-dd").alias("duedate"),
        F.col("original_estimate").alias("timeoriginalestimate"), F.col("time_spent").alias("timespent"),
        F.col("remaining_estimate").alias("timeestimate"),
        F.col("story_points").cast("string").alias("story_points"),
        "acceptance_criteria",
    )
    hist = F.filter(F.array(item(F.col("in_progress_at"), "In Progress"), item(F.col("done_at"), "Done")), lambda h: h.isNotNull())
    docs = t.issues.join(keys, "project_id").select(
        F.col("id").alias("page"), "projectKey", F.col("sprint_id").alias("sprintId"),
        F.col("id").cast("string").alias("id"), F.col("jira_issue_id").alias("key"), fields.alias("fields"),
        F.struct(F.lit(0).cast("long").alias("startAt"), hist.alias("histories")).alias("changelog"),
    )
    landed.write_json(landed.as_envelopes(docs), p(landing, "issues"), ISSUES_PER_FILE)
