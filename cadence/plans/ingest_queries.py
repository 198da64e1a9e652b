"""Registered queries of the ingest side (silver layer, upserts, audits, stream).

Inputs are derived from the test tables by fixed rules (FIXTURES.md §2) so
the DuckDB oracle can compute the expected result from the same tables.
Queries that only read delivery tables take others as ``t``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.expr import has_ac, iso
from ..operators import completeness, listing, quality, silver, sync, upsert
from ..session import ensure_checkpoint_dir
from ..sources import landed, testdata
from ..sources.tables import Tables
from ..streaming import counters, ingest, runs
from .inputs import tables

# Fixed values of the ingest fixtures.
DOC_AC_MARKERS = ("license", "the ")
STREAM_BUCKETS = 16


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return testdata.read(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("k"), "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("od")
    )


def parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    ch = landed.event_changes(spark, d)
    return ch.select(
        F.col("seq").alias("event_id"),
        (F.col("seq") % 5).alias("variant"),
        iso(X.parse_ts(F.col("created"))).alias("parsed"),
    )


def transition_dates(spark: SparkSession, d: str) -> DataFrame:
    t = silver.transition_dates_by_issue(landed.changelog_pages(spark, d))
    return t.select("issue_id", iso("in_progress_at").alias("in_progress_at"), iso("done_at").alias("done_at"))


def status_history(spark: SparkSession, d: str) -> DataFrame:
    h = silver.status_history(landed.changelog_pages(spark, d))
    return h.select("issue_id", "from_status", "to_status", iso("transitioned_at").alias("transitioned_at"), "author_email")


BATCH_SPEC = upsert.MergeSpec(
    key="jira_issue_id",
    overwrite=("sprint_id", "status", "story_points"),
    insert_only=("summary", "created_at_jira"),
    sticky=("in_progress_at", "done_at"),
)


def issue_batch_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = testdata.read(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    versions = e.select(
        F.concat(F.lit("EV-"), F.col("user_id").cast("string")).alias("jira_issue_id"),
        F.col("event_id").cast("long").alias("seq"),
        F.dayofmonth(ts).cast("long").alias("sprint_id"),
        F.col("event_type").alias("status"),
        F.col("value").alias("story_points"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string")).alias("summary"),
        ts.alias("created_at_jira"),
        F.when(F.col("event_type") == "click", ts).alias("in_progress_at"),
        F.when(F.col("event_type") == "purchase", ts).alias("done_at"),
    )
    c = upsert.collapse_batch(versions, BATCH_SPEC, seq="seq")
    return silver.iso_cols(c, "created_at_jira", "in_progress_at", "done_at")


def story_points_parse(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    k = F.col("k")
    a = (
        F.when(k % 6 == 1, F.lit("")).when(k % 6 == 2, F.lit("0"))
        .when(k % 6 == 3, F.concat((k % 13).cast("string"), F.lit(".5")))
        .when(k % 6 == 4, F.lit("n/a")).when(k % 6 == 5, F.lit("0.0"))
    )
    b = F.when(k % 4 != 0, (k % 8).cast("string"))
    return o.select(k.alias("id"), a.alias("configured"), b.alias("fallback"), X.story_points(a, b).alias("story_points"))


def story_point_impute(spark: SparkSession, d: str, t: Tables | None = None) -> DataFrame:
    i = (t or tables(spark, d)).issues
    return silver.impute_story_points(i).select("id", F.col("story_points").cast("double").alias("story_points"))


def has_ac_flag(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    ac = (
        F.when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.expr("repeat(' ', cast(k % 3 + 1 as int))"))
        .when(k % 4 == 3, F.col("o_orderpriority"))
    )
    return _orders(spark, d).select(k.alias("id"), ac.alias("acceptance_criteria"), has_ac(ac).alias("has_ac"))


def added_mid_sprint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    created = F.col("od") - F.make_dt_interval((k % 30).cast("int"))
    start = F.when(k % 7 != 0, F.date_trunc("MONTH", F.col("od")))
    return _orders(spark, d).select(
        k.alias("id"), iso(created).alias("created_at_jira"), iso(start).alias("sprint_start"),
        X.added_mid_sprint(created, start).alias("added_mid_sprint"),
    )


def acceptance_criteria(spark: SparkSession, d: str) -> DataFrame:
    docs = testdata.read(spark, d, "documents").select("doc_id", "text")
    ded = F.when(F.col("doc_id") % 5 == 0, F.lit("Given the dedicated field")).when(F.col("doc_id") % 5 == 1, F.lit("   "))
    ac = X.acceptance_criteria(ded, F.col("text"), DOC_AC_MARKERS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ac.alias("acceptance_criteria"), has_ac(ac).alias("has_ac"))


def rich_text_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation turn as a nested rich-text document (one paragraph per line)."""
    c = testdata.read(spark, d, "conversations")
    para = F.transform(
        F.split(F.col("text"), "\n"),
        lambda line: F.struct(
            F.lit("paragraph").alias("type"),
            F.array(F.struct(F.lit("text").alias("type"), line.alias("text"))).alias("content"),
        ),
    )
    doc = F.to_json(F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"), para.alias("content")))
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), doc.alias("doc"))


def rich_text_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = rich_text_docs(spark, d)
    return docs.select("conv_id", "turn", X.extract_text(F.col("doc")).alias("text"))


def rich_text_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = rich_text_docs(spark, d)
    return docs.select("conv_id", "turn", X.extract_text_exact(F.col("doc")).alias("text"))


def sync_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The run log of one pull a day: issue documents by project, sprint documents, and a project without any."""
    e = testdata.read(spark, d, "events")
    pull = F.datediff(F.col("ts").cast("timestamp").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    docs = e.select(pull.alias("pull"), F.concat(F.lit("P"), F.col("user_id") % 4).alias("projectKey"), "event_type")
    keys = spark.range(5).select(F.col("id").alias("project_id"), F.concat(F.lit("P"), F.col("id")).alias("jira_key"))
    projects = docs.select("pull").distinct().select("pull", F.explode(F.lit([f"P{k}" for k in range(5)])).alias("jira_key"))
    log = sync.run_log(projects, docs, docs.where("event_type = 'view'"), keys, F.lit("2024-01-01").cast("timestamp"))
    return log.groupBy("project_id", "sync_type", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("issues_synced").alias("issues_synced"), F.sum("sprints_synced").alias("sprints_synced"),
        F.min("issues_synced").alias("fewest_issues"),
    )


def project_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d).projects
    existing = p.filter(F.col("id") % 3 != 0).withColumn("board_id", F.col("id") * 10)
    incoming = (
        p.filter((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0))
        .withColumn("name", F.concat(F.col("name"), F.lit(" (renamed)")))
        .withColumn("description", F.lit("v2"))
        .withColumn("board_id", F.lit(None).cast("long"))
    )
    m = upsert.merge(existing, incoming, upsert.PROJECT_SPEC)
    return m.select("id", "jira_key", "name", "description", "board_id")


def sprint_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = tables(spark, d).sprints
    existing = s.filter(F.col("id") % 3 != 0)
    incoming = (
        s.filter((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0))
        .withColumn("name", F.concat(F.col("name"), F.lit(" v2")))
        .withColumn("state", F.lit("closed"))
        .withColumn("project_id", F.col("project_id") + 100)
    )
    m = upsert.merge(existing, incoming, upsert.SPRINT_SPEC)
    return m.select(
        "id", "jira_sprint_id", "project_id", "name", "state",
        iso("start_date").alias("start_date"), iso("complete_date").alias("complete_date"),
    )


def issue_upsert(spark: SparkSession, d: str, t: Tables | None = None) -> DataFrame:
    i = (t or tables(spark, d)).issues
    existing = i.filter(F.col("id") % 3 != 0)
    day = F.make_dt_interval(F.lit(1))
    incoming = (
        i.filter((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0))
        .withColumn("summary", F.concat(F.lit("Changed "), F.col("id").cast("string")))
        .withColumn("status_category", F.lit("In Progress"))
        .withColumn("story_points", (F.col("story_points") + F.lit(1)).cast("decimal(6,1)"))
        .withColumn("sprint_id", F.when(F.col("id") % 4 != 0, F.col("sprint_id")))
        .withColumn("in_progress_at", F.col("created_at_jira") + day)
        .withColumn("done_at", F.when(F.col("id") % 4 == 2, F.col("created_at_jira") + day + day))
        .withColumn("time_spent", F.coalesce(F.col("time_spent"), F.lit(0)) + F.lit(600))
        .withColumn("original_estimate", F.lit(0).cast("long"))
    )
    m = upsert.merge(existing, incoming, upsert.ISSUE_SPEC)
    return m.select(
        "id", "jira_issue_id", "sprint_id", "status_category",
        F.col("story_points").cast("double").alias("story_points"), "summary", "original_estimate", "time_spent",
        iso("in_progress_at").alias("in_progress_at"), iso("done_at").alias("done_at"),
    )


def issue_upsert_stamps(spark: SparkSession, d: str, t: Tables | None = None) -> DataFrame:
    """``updated_at`` after an upsert: the batch's instant on touched issues, the former one on others."""
    i = (t or tables(spark, d)).issues
    existing = i.where(F.col("id") % 3 != 0).withColumn("updated_at", F.col("created_at_jira"))
    incoming = i.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0))
    m = upsert.merge(existing, incoming, upsert.ISSUE_SPEC, as_of=F.lit("2030-01-02 03:04:05").cast("timestamp"))
    return m.select("id", "jira_issue_id", iso("updated_at").alias("updated_at"))


ORDER_RULES = {
    "orders": quality.Rules(not_null=("o_orderkey",), domains={"o_orderstatus": ("F", "O", "P")}, unique=(("o_orderkey",),), foreign={"o_custkey": ("customer", "c_custkey")}),
    "lineitem": quality.Rules(unique=(("l_orderkey", "l_linenumber"),), foreign={"l_orderkey": ("orders", "o_orderkey")}),
}


def constraint_audit(spark: SparkSession, d: str, t: Tables | None = None) -> DataFrame:
    """The delivery tables' constraints, and key rules of the raw order tables."""
    raw = {n: testdata.read(spark, d, n) for n in ("orders", "lineitem", "customer")}
    t = t or tables(spark, d)
    delivery = {n: getattr(t, n) for n in quality.DELIVERY_RULES}
    return quality.audit(raw, ORDER_RULES).unionByName(quality.audit(delivery, quality.DELIVERY_RULES))


def _stream_context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Projects and sprints of the streamed issues: four projects, and a sprint for each tenth user with a start from the events."""
    projects = spark.range(4).select(F.col("id"), F.concat(F.lit("P"), F.col("id")).alias("jira_key"))
    e = testdata.read(spark, d, "events").where(F.col("user_id") % 10 != 0)
    start = F.date_trunc("DAY", F.min(F.col("ts").cast("timestamp"))) + F.make_dt_interval((F.col("id") * 2).cast("int"))
    return projects, e.groupBy((F.col("user_id") % 10).cast("long").alias("id")).agg(start.alias("start_date"))


def incremental_ingest(spark: SparkSession, d: str, max_files_per_trigger: int = 16) -> DataFrame:
    """Land change-log pages in two drops, the later pages first, and drain each with an availableNow stream."""
    root = os.path.join(ensure_checkpoint_dir(spark), "incremental-" + uuid.uuid4().hex)
    landing, store, ckpt = (os.path.join(root, x) for x in ("landing", "store", "_checkpoint"))
    pages = landed.changelog_pages(spark, d)
    user = F.col("issue_id")
    pages = pages.withColumn("projectKey", F.concat(F.lit("P"), user % 4)).withColumn("sprintId", F.when(user % 10 != 0, user % 10))
    env = landed.as_envelopes(pages)
    half = pages.agg(F.max("page").alias("m")).first()["m"] // 2
    for n, cond in enumerate([F.col("page") > half, F.col("page") <= half]):
        landed.write_json(env.filter(cond), os.path.join(landing, f"drop={n}"))
        # Bucket count sized to the test tables (a layout parameter; every
        # row is still merged and returned).
        ingest.run_available(spark, os.path.join(landing, "*"), store, ckpt, max_files_per_trigger, buckets=STREAM_BUCKETS)
    out = ingest.silver_tables(spark, store, *_stream_context(spark, d))
    changes = out.status_history.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return out.issues.join(changes, out.issues["id"] == changes["issue_id"], "left").select(
        "id", "jira_issue_id", "project_id", "sprint_id", "issue_type", "priority", "status", "status_category",
        F.col("story_points").cast("double").alias("story_points"), "summary", "description", "acceptance_criteria", "has_ac",
        "original_estimate", "time_spent", "remaining_estimate", "assignee_email", "reporter_email",
        iso("created_at_jira").alias("created_at_jira"), iso("updated_at_jira").alias("updated_at_jira"),
        iso("in_progress_at").alias("in_progress_at"), iso("done_at").alias("done_at"),
        F.col("due_date").cast("string").alias("due_date"), "added_mid_sprint", F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
    )


def sync_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Delivery tables → landed JSON documents → batch sync → silver issues."""
    root = os.path.join(ensure_checkpoint_dir(spark), "sync-" + uuid.uuid4().hex)
    sync.land_tables(tables(spark, d), os.path.join(root, "landing"))
    out = sync.sync_batch(spark, os.path.join(root, "landing"), bronze=os.path.join(root, "bronze"))
    return out.issues.select(
        "id", "jira_issue_id", "project_id", "sprint_id", "issue_type", "status", "status_category",
        F.col("story_points").cast("double").alias("story_points"), "has_ac", "added_mid_sprint",
        iso("in_progress_at").alias("in_progress_at"), iso("done_at").alias("done_at"),
        "original_estimate", "time_spent",
    )


def two_pull_sync(spark: SparkSession, d: str) -> DataFrame:
    """Two pulls of changed projects, sprints and issues in one landing, with the run log."""
    landing = os.path.join(ensure_checkpoint_dir(spark), "pulls-" + uuid.uuid4().hex)
    t = tables(spark, d)
    even = lambda c, v: F.when(F.col("id") % 2 == 0, v).otherwise(F.col(c))
    sync.land_tables(t, landing, pull=0)
    sync.land_tables(
        t.with_(
            projects=t.projects.withColumn("name", even("name", F.concat("name", F.lit(" r2")))),
            sprints=t.sprints.withColumn("name", even("name", F.concat("name", F.lit(" v2")))).withColumn("state", even("state", F.lit("closed"))),
            issues=t.issues.where(F.col("id") % 3 == 0)
            .withColumn("sprint_id", F.when(F.col("id") % 6 != 0, F.col("sprint_id")))
            .withColumn("status", F.lit("Reopened")).withColumn("summary", F.lit("not taken over")),
        ),
        landing, pull=1,
    )
    out = sync.sync_batch(spark, landing, bronze=landing + "-bronze", full=True)
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        out.projects.select(F.lit("project").alias("kind"), F.col("jira_key").alias("key"), "name", none("string").alias("state"), "id", none("long").alias("n")),
        out.sprints.select(F.lit("sprint").alias("kind"), F.col("jira_sprint_id").cast("string").alias("key"), "name", "state", F.col("project_id").alias("id"), none("long").alias("n")),
        out.issues.select(F.lit("issue").alias("kind"), F.col("jira_issue_id").alias("key"), F.col("summary").alias("name"), F.col("status").alias("state"), F.col("sprint_id").alias("id"), none("long").alias("n")),
        out.sync_log.select(F.lit("run").alias("kind"), F.col("sync_type").alias("key"), F.col("status").alias("name"), none("string").alias("state"), F.col("issues_synced").alias("id"), F.col("sprints_synced").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Good and broken pages landed together: what was kept, set aside, or had points that do not fit."""
    landing = os.path.join(ensure_checkpoint_dir(spark), "broken-" + uuid.uuid4().hex)
    pages = landed.changelog_pages(spark, d).withColumn("page", F.col("page") * 1_000_000 + F.col("issue_id"))
    large = F.col("fields").withField("story_points", F.when(F.col("issue_id") % 10 == 1, F.lit("12345678")).otherwise(F.col("fields.story_points")))
    env = landed.as_envelopes(pages.withColumn("fields", large))
    line = F.to_json(F.struct(*env.columns))
    broken = F.when(F.col("page") % 7 == 3, F.expr("left(line, length(line) div 2)")).otherwise(F.col("line"))
    env.select("page", line.alias("line")).select(broken.alias("value")).write.text(os.path.join(landing, "issues"))
    read = landed.read_json(spark, os.path.join(landing, "issues"), landed.envelope_schema(landed.schemas.issue_doc()))
    flat = landed.flatten_pages(read)
    counted = [("kept", flat), ("quarantined", landed.quarantine(read)), ("points_do_not_fit", silver.unstorable_points(flat))]
    out = None
    for name, df in counted:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def history_append(spark: SparkSession, d: str) -> DataFrame:
    """Status history appended to what an earlier pull left: only unseen rows are new."""
    pages = landed.changelog_pages(spark, d)
    earlier = silver.status_history(pages.where(F.col("issue_id") % 2 == 0))
    new = silver.append_history(earlier, silver.status_history(pages))
    both = earlier.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    return both.select("issue_id", "from_status", "to_status", iso("transitioned_at").alias("transitioned_at"), "author_email", "is_new")


def _scratch(spark: SparkSession, label: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stream_counters(spark: SparkSession, d: str, max_files_per_trigger: int = 16) -> DataFrame:
    """Sprint, backlog and distribution counters after a stream of two drops, summed from the deltas of its batches.

    Later pages of an issue's change log come first, move it to another sprint
    and reopen or finish it.
    """
    root = _scratch(spark, "counters")
    landing, store, ckpt = (os.path.join(root, x) for x in ("landing", "store", "_checkpoint"))
    place = (F.col("issue_id") + F.col("page")) % 10
    pages = landed.changelog_pages(spark, d).withColumn("projectKey", F.concat(F.lit("P"), F.col("issue_id") % 4)).withColumn("sprintId", F.when(place != 0, place))
    env = landed.as_envelopes(pages)
    _, sprints = _stream_context(spark, d)
    half = pages.agg(F.max("page").alias("m")).first()["m"] // 2
    for n, cond in enumerate([F.col("page") > half, F.col("page") <= half]):
        landed.write_json(env.filter(cond), os.path.join(landing, f"drop={n}"))
        ingest.run_available(spark, os.path.join(landing, "*"), store, ckpt, max_files_per_trigger, buckets=STREAM_BUCKETS, sprints=sprints)
    counted = counters.read(spark, store).persist()
    parts = (
        ("sprint", counters.sprint_counters(counted), F.col("sprint_id").cast("string")), ("backlog", counters.backlog_counters(counted), F.col("issue_type")),
        ("status", counters.status_counters(counted), F.concat_ws("/", "issue_type", "status")),
    )
    out = None
    for kind, rows, name in parts:
        row = rows.select(F.lit(kind).alias("kind"), "project_key", name.alias("name"), "total_issues", "done_issues", "added_issues", "total_points", "completed_points", "added_points")
        out = row if out is None else out.unionByName(row)
    return out


def stream_repair(spark: SparkSession, d: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Broken lines set aside by the stream, half of them mended and merged: issues and lines before and after."""
    root = _scratch(spark, "repair")
    landing, store, ckpt = (os.path.join(root, x) for x in ("landing", "store", "_checkpoint"))
    pages = landed.changelog_pages(spark, d).withColumn("page", F.col("page") * 1_000_000 + F.col("issue_id"))
    env = landed.as_envelopes(pages)
    lines = env.select("page", F.to_json(F.struct(*env.columns)).alias("line"))
    half = F.expr("left(line, length(line) div 2)")
    lines.select(F.when(F.col("page") % 7 == 3, half).otherwise(F.col("line")).alias("value")).write.text(landing)
    ingest.run_available(spark, landing, store, ckpt, max_files_per_trigger, buckets=STREAM_BUCKETS)

    def state(when: str) -> list[DataFrame]:
        counted = (("issues", ingest.read_state(spark, store)), ("lines aside", ingest.quarantined(spark, store)))
        # Written at once: the repair changes the store.
        return [df.agg(F.count("*").alias("n")).select(F.lit(f"{what} {when}").alias("outcome"), "n") for what, df in counted]

    before = state("before")
    taken = os.path.join(root, "before")
    before[0].unionByName(before[1]).write.parquet(taken)
    whole = lines.where("page % 7 = 3 and page % 2 = 1").select(half.alias("record"), F.col("line").alias("value"))
    mended = ingest.quarantined(spark, store).join(whole, "record").select("seq_file", "record", "value")
    ingest.repair(spark, store, mended, buckets=STREAM_BUCKETS)
    out = spark.read.schema("outcome string, n long").parquet(taken)
    for row in state("after"):
        out = out.unionByName(row)
    return out


def run_life_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Two logged pulls of all projects, the second of a landing without issue pages: its runs fail, the first one's stay the last good ones."""
    root = _scratch(spark, "runs")
    t = tables(spark, d)
    keys = [r.jira_key for r in t.projects.select("jira_key").collect()]
    sync.land_tables(t, os.path.join(root, "landing-0"))
    first = runs.sync_logged(spark, os.path.join(root, "landing-0"), os.path.join(root, "v0"), os.path.join(root, "log"), 0, keys, bronze=os.path.join(root, "bronze"))
    t.projects.select(F.col("id").cast("string").alias("id"), F.col("jira_key").alias("key")).write.json(os.path.join(root, "landing-1", "projects"))
    try:
        runs.sync_logged(spark, os.path.join(root, "landing-1"), os.path.join(root, "v1"), os.path.join(root, "log"), 1, keys, current=first)
    except AnalysisException:
        pass
    state = runs.states(spark, os.path.join(root, "log"))
    log = runs.sync_log(state, first.projects.select(F.col("id").alias("project_id"), "jira_key"))
    good = listing.project_sync_meta(first.with_(sync_log=log)).select("jira_key", F.col("last_sync_ok").isNotNull().alias("has_good_run"))
    rows = state.select("jira_key", "pull", "status", F.col("message").isNotNull().alias("has_message"), "issues", "sprints", (F.col("finished_at") >= F.col("started_at")).alias("finished"))
    return rows.join(good, "jira_key")


def page_completeness(spark: SparkSession, d: str) -> DataFrame:
    """What is missing from landed chains with lost pages: item ranges, chains without an end, tokens that no page was asked by."""
    size, root = 20, _scratch(spark, "pages")
    e = testdata.read(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"))
    kind, item = F.col("event_id") % 3, F.floor(F.col("event_id") / 3)
    pages = e.groupBy(kind.alias("kind"), F.floor(item / size).alias("page")).agg(F.count("*").alias("n"))
    last = pages.groupBy("kind").agg(F.max("page").alias("last"), F.sum("n").alias("items"))
    made = pages.join(last, "kind")
    name = lambda p: F.concat(F.lit("t"), p.cast("string"))
    docs = F.expr("transform(sequence(1, cast(n as int)), i -> named_struct('id', cast(page * 1000 + i as string)))")
    env = made.select(
        "page", F.concat(F.lit("P"), F.col("kind")).alias("projectKey"), F.lit(0).cast("long").alias("pull"),
        F.when(F.col("kind") != 2, F.col("page") * size).alias("startAt"), F.when(F.col("kind") == 0, F.col("items")).alias("total"),
        F.when(F.col("kind") == 1, F.col("page") == F.col("last")).alias("isLast"),
        F.when((F.col("kind") == 2) & (F.col("page") > 0), name(F.col("page"))).alias("pageToken"),
        F.when((F.col("kind") == 2) & (F.col("page") < F.col("last")), name(F.col("page") + 1)).alias("nextPageToken"),
        F.when(F.col("kind") != 1, docs).alias("issues"), F.when(F.col("kind") == 1, docs).alias("values"),
    )
    lost = (F.col("page") % 11).isin(3, 4) | (F.col("page") == F.col("last")) & (F.col("kind") == 1) | (F.col("page") == 0) & (F.col("kind") == 2)
    env.join(last.select(F.concat(F.lit("P"), F.col("kind")).alias("projectKey"), "kind", "last"), "projectKey").where(~lost).drop("kind", "last").write.json(os.path.join(root, "issues"))
    read = landed.read_json(spark, os.path.join(root, "issues"), landed.envelope_schema(landed.schemas.issue_doc()))
    return completeness.missing_pages(read)


INGEST_QUERIES = {
    "stream_counters": stream_counters,
    "stream_repair": stream_repair,
    "run_life_cycle": run_life_cycle,
    "page_completeness": page_completeness,
    "history_append": history_append,
    "two_pull_sync": two_pull_sync,
    "quarantine_counts": quarantine_counts,
    "sync_roundtrip": sync_roundtrip,
    "has_ac_flag": has_ac_flag,
    "added_mid_sprint": added_mid_sprint,
    "parse_timestamps": parse_timestamps,
    "story_points_parse": story_points_parse,
    "story_point_impute": story_point_impute,
    "acceptance_criteria": acceptance_criteria,
    "rich_text_extract": rich_text_extract,
    "rich_text_exact": rich_text_exact,
    "transition_dates": transition_dates,
    "status_history": status_history,
    "project_upsert": project_upsert,
    "sprint_upsert": sprint_upsert,
    "issue_upsert": issue_upsert,
    "issue_upsert_stamps": issue_upsert_stamps,
    "issue_batch_collapse": issue_batch_collapse,
    "sync_run_summary": sync_run_summary,
    "constraint_audit": constraint_audit,
    "incremental_ingest": incremental_ingest,
}
