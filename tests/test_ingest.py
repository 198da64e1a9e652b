"""Upsert semantics, landed pages and the incremental stream."""

import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.operators import upsert
from cadence.sources import landed
from cadence.streaming import ingest
from tests import brute
from tests.conftest import SMOKE_DIR
from tests.seed import ISSUES, SPRINTS

SPEC = upsert.MergeSpec(key="k", overwrite=("o",), insert_only=("i",), sticky=("s",))
SCHEMA = "k string, seq long, o long, i long, s long"


def fold(existing, batch):
    """Row-by-row upsert, the reference's loop: insert, or update by column class."""
    table = {r[0]: dict(zip(("k", "o", "i", "s"), (r[0], r[1], r[2], r[3]))) for r in existing}
    for k, _seq, o, i, s in sorted(batch, key=lambda r: r[1]):
        if k not in table:
            table[k] = {"k": k, "o": o, "i": i, "s": s}
        else:
            row = table[k]
            row["o"] = o
            row["s"] = row["s"] if row["s"] is not None else s
    return sorted((r["k"], r["o"], r["i"], r["s"]) for r in table.values())


def test_same_issue_in_two_sprints(spark):
    batch = spark.createDataFrame(
        [("X-1", 1, 10, 100, None), ("X-1", 2, 20, 200, 7), ("X-1", 3, 30, 300, 9)], SCHEMA)
    r = upsert.collapse_batch(batch, SPEC).collect()[0]
    assert (r.o, r.i, r.s, r.seq) == (30, 100, 7, 3)


def test_rerun_is_idempotent(spark):
    batch = spark.createDataFrame([("A", 1, 1, 1, None), ("B", 2, 2, 2, 5)], SCHEMA)
    once = upsert.upsert(spark.createDataFrame([], "k string, o long, i long, s long"), batch, SPEC)
    twice = upsert.upsert(once, batch, SPEC)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(*once.columns).collect()))


rows = st.lists(
    st.tuples(st.sampled_from("abcd"), st.integers(0, 5), st.integers(0, 5), st.one_of(st.none(), st.integers(0, 5))),
    max_size=12,
)


@settings(max_examples=15, deadline=None)
@given(existing=rows, batch=rows)
def test_set_upsert_equals_sequential_fold(spark, existing, batch):
    ex = {}
    for k, o, i, s in existing:
        ex.setdefault(k, (k, o, i, s))
    b = [(k, n, o, i, s) for n, (k, o, i, s) in enumerate(batch)]
    e_df = spark.createDataFrame(list(ex.values()), "k string, o long, i long, s long")
    b_df = spark.createDataFrame(b, SCHEMA)
    got = sorted(tuple(r) for r in upsert.upsert(e_df, b_df, SPEC).select("k", "o", "i", "s").collect())
    assert got == fold(list(ex.values()), b)


def test_pages_round_trip_three_envelopes(spark):
    pages = landed.changelog_pages(spark, SMOKE_DIR, page_size=64)
    out = tempfile.mkdtemp(prefix="cadence-pages-")
    landed.as_envelopes(pages).write.mode("overwrite").json(os.path.join(out, "p"))
    flat = landed.read_pages(spark, os.path.join(out, "p"))
    assert flat.count() == pages.count()
    assert flat.select("key").distinct().count() == pages.select("key").distinct().count()


def test_sync_batch_roundtrip_on_seed(spark, seed):
    from cadence.operators import metrics, sync

    from pyspark.sql import Observation

    root = tempfile.mkdtemp(prefix="cadence-sync-")
    seeded = seed.with_(projects=seed.projects.withColumn("board_id", F.lit(42).cast("long")))
    sync.land_tables(seeded, os.path.join(root, "landing"))
    obs = Observation("sync")
    out = sync.sync_batch(spark, os.path.join(root, "landing"), impute=False, observation=obs)
    assert out.projects.collect()[0].board_id == 42
    in_sprints = sum(i[1] is not None for i in ISSUES)
    assert out.issues.count() == len(ISSUES)
    assert obs.get == {"issue_documents": len(ISSUES), "sprint_issue_documents": in_sprints}
    # The sync recomputes added_mid_sprint from creation time vs sprint start;
    # every seed issue was created 60 days ago, before any sprint began, so
    # none is mid-sprint and committed = all points.
    assert out.issues.filter("added_mid_sprint").count() == 0
    v = metrics.velocity(out, 1, 3).collect()[0]
    everything = [brute.sprint(s)["points"] for s in brute.CLOSED[:3]]
    assert (v.average_completed_points, v.average_committed_points) == (brute.velocity(3)[0], brute.r2(sum(everything) / 3))
    log = out.sync_log.collect()
    assert [(r.issues_synced, r.sprints_synced, r.status) for r in log] == [(len(ISSUES), len(SPRINTS), "success")]
    # A second sync of the same landing changes no issue and appends no history.
    again = sync.sync_batch(spark, os.path.join(root, "landing"), current=out, impute=False)
    cols = ["jira_issue_id", "sprint_id", "status", "story_points", "in_progress_at", "done_at"]
    assert sorted(map(tuple, again.issues.select(cols).collect())) == sorted(map(tuple, out.issues.select(cols).collect()))
    assert again.status_history.count() == out.status_history.count()


def _land(env, landing, drop, cond):
    env.filter(cond).repartition(4).write.json(os.path.join(landing, f"drop={drop}"))


COLUMNS = [
    "jira_issue_id", "project_key", "sprint_id", "status", "story_points", "in_progress_at", "done_at",
    "created_at_jira", "updated_at_jira", "last_created",
]


def _state(spark, store):
    return sorted(map(str, ingest.read_state(spark, store).select(*COLUMNS).collect()))


def _pages(spark):
    pages = landed.changelog_pages(spark, SMOKE_DIR, page_size=64)
    return landed.as_envelopes(pages.withColumn("projectKey", F.lit("P")).withColumn("sprintId", F.col("page") % 3)), pages


def test_stream_result_does_not_depend_on_batches_or_order(spark):
    env, pages = _pages(spark)
    results = []
    for order, files in (((0, 1, 2), 1000), ((2, 0, 1), 2), ((1, 2, 0), 5)):
        root = tempfile.mkdtemp(prefix="cadence-stream-")
        landing, store, ckpt = (os.path.join(root, x) for x in ("landing", "store", "ckpt"))
        for drop in order:
            _land(env, landing, drop, F.col("page") % 3 == drop)
            ingest.run_available(spark, os.path.join(landing, "*"), store, ckpt, files, buckets=4)
        history = ingest.read_appended(spark, store, "history", ingest.schemas.STATUS_HISTORY)
        assert history.count() == history.distinct().count() > 0
        results.append((_state(spark, store), sorted(map(str, history.collect()))))
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) == pages.select("key").distinct().count()


def test_replayed_and_unfinished_batches_change_nothing(spark):
    env, _ = _pages(spark)
    store = os.path.join(tempfile.mkdtemp(prefix="cadence-store-"), "s")
    writer = ingest.make_batch_writer(store, buckets=4)
    pages = env.withColumn("seq_file", F.lit("f")).withColumn(landed.CORRUPT, F.lit(None).cast("string"))
    writer(pages, 0)
    before = _state(spark, store)
    writer(pages.filter(F.col("page") % 2 == 0), 1)  # landed again
    writer(pages.filter(F.col("page") % 2 == 0), 1)  # and that batch retried
    assert _state(spark, store) == before
    # A batch that wrote its files but no commit is invisible.
    broken = ingest.read_state(spark, store).withColumn("status", F.lit("lost")).withColumn("bucket", ingest.key_bucket(F.col("jira_issue_id"), 4))
    broken.write.partitionBy("bucket").parquet(os.path.join(store, "data", "batch=7"))
    assert _state(spark, store) == before
    assert all(os.path.isdir(f) for f in ingest.vacuum(spark, store)) and len(ingest.vacuum(spark, store)) == 4


def test_stream_batch_rewrites_only_touched_buckets(spark):
    env, pages = _pages(spark)
    store = os.path.join(tempfile.mkdtemp(prefix="cadence-buckets-"), "s")
    writer = ingest.make_batch_writer(store, buckets=8)
    env = env.withColumn("seq_file", F.lit("f"))
    writer(env, 0)
    key = pages.select(F.min("key")).first()[0]
    one = env.filter(F.exists(F.coalesce("issues", "values"), lambda i: i["key"] == key))
    writer(one, 1)
    changed = {bucket for bucket, batch in ingest.committed(spark, store, "data") if batch == 1}
    assert changed == {spark.range(1).select(ingest.key_bucket(F.lit(key), 8)).first()[0]}


def test_stream_gives_tables_that_metrics_read(spark):
    from cadence.operators import metrics
    from cadence.sources.tables import load_tables, write_tables

    env, _ = _pages(spark)
    root = tempfile.mkdtemp(prefix="cadence-silver-")
    ingest.make_batch_writer(os.path.join(root, "s"), buckets=4)(env.withColumn("seq_file", F.lit("f")), 0)
    projects = spark.createDataFrame([(7, "P", "P")], "id long, jira_key string, name string")
    sprints = spark.range(3).select("id", F.lit(7).cast("long").alias("project_id"), F.timestamp_seconds(F.lit(0)).alias("start_date"))
    silver = ingest.silver_tables(spark, os.path.join(root, "s"), projects, sprints)
    write_tables(silver, os.path.join(root, "out"))
    t = load_tables(spark, os.path.join(root, "out"))
    assert metrics.distribution_by_status(t, 7).count() > 0
    assert t.issues.where("project_id <> 7 or sprint_id is null").count() == 0
    assert t.issues.where("added_mid_sprint").count() > 0
    assert t.sync_log.first().issues_synced == env.count()


def test_two_pulls_collapse_projects_and_sprints(spark, seed):
    from cadence.operators import sync

    landing = os.path.join(tempfile.mkdtemp(prefix="cadence-pulls-"), "landing")
    sync.land_tables(seed, landing, pull=0)
    sync.land_tables(seed.with_(sprints=seed.sprints.withColumn("name", F.lit("new"))), landing, pull=1)
    out = sync.sync_batch(spark, landing)
    assert out.projects.count() == seed.projects.count() and out.sprints.count() == seed.sprints.count()
    assert {r.name for r in out.sprints.collect()} == {"new"} and out.sync_log.count() == 2


def test_pages_without_a_number_and_broken_lines(spark):
    landing = os.path.join(tempfile.mkdtemp(prefix="cadence-broken-"), "issues")
    doc = '{"issues":[{"id":"%d","key":"A-%d","fields":{"summary":"s","status":{"name":"%s"},"story_points":"%s"}}]%s}'
    lines = [doc % (1, 1, "Old", "1", ""), doc % (1, 1, "New", "1e7", ',"page":4'), (doc % (2, 2, "x", "3", ',"page":5'))[:-20], "not json", doc % (3, 3, "y", "2.5", "")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(landing)
    read = landed.read_json(spark, landing, landed.envelope_schema(landed.schemas.issue_doc()))
    from cadence.operators import silver, sync

    flat = landed.flatten_pages(read)
    rows = {r.jira_issue_id: r for r in upsert.collapse_batch(sync.document_rows(flat), sync.ISSUE_DOCS).collect()}
    assert {k: (r.id, r.status) for k, r in rows.items()} == {"A-1": (1, "New"), "A-3": (3, "y")}
    assert rows["A-1"].story_points is None and silver.unstorable_points(flat).count() == 1
    assert landed.quarantine(read).count() == 2


def test_sync_joins_carry_no_change_logs(spark, seed):
    from cadence.operators import sync

    landing = os.path.join(tempfile.mkdtemp(prefix="cadence-narrow-"), "landing")
    sync.land_tables(seed, landing)
    plan = sync.sync_batch(spark, landing).issues._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and not any("changelog" in line for line in joins)
    below = plan[plan.index("Join "):]
    # Documents are read and collapsed below the aggregate, never directly below a join.
    assert below.index("Aggregate") < below.index("changelog")
