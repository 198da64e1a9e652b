"""What must not grow faster than its input: landed bytes, passes over a batch's rows, tasks of a micro-batch."""

import os
import tempfile

from pyspark.sql import functions as F

from cadence.operators import sync
from cadence.sources import landed, schemas
from cadence.sources.tables import empty
from cadence.streaming import history, ingest
from cadence.streaming import store as S
from tests.conftest import SMOKE_DIR


def _dir(label):
    return tempfile.mkdtemp(prefix=f"cadence-{label}-")


def test_landed_issue_pages_are_compressed_and_read_the_same(spark, seed):
    landing = _dir("landing")
    sync.land_tables(seed, landing)
    folder = os.path.join(landing, "issues", "pull=0")
    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert files and all(f.endswith(".json.lz4") for f in files)
    out = sync.sync_batch(spark, landing, bronze=os.path.join(landing, "bronze"))
    want = {(r.jira_issue_id, r.sprint_id, r.summary) for r in seed.issues.collect()}
    assert {(r.jira_issue_id, r.sprint_id, r.summary) for r in out.issues.collect()} == want


def test_landed_files_are_bounded(spark):
    path = os.path.join(_dir("files"), "p")
    landed.write_json(spark.range(10, numPartitions=1), path, max_records_per_file=3)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 4
    assert sorted(r.id for r in spark.read.schema("id long").json(path).collect()) == list(range(10))


def _rows(spark, rows):
    return spark.createDataFrame(rows, "jira_issue_id string, project_key string, sprint_id long, at string").select(
        "jira_issue_id", "project_key", "sprint_id", F.col("at").cast("timestamp").alias("last_created")
    )


def test_resolve_evaluates_its_rows_once(spark):
    rows = _rows(spark, [("A-1", "A", 1, "2024-01-03"), ("A-2", "A", None, "2024-01-03"), ("B-1", "B", 9, "2024-01-03"), (None, None, None, None), ("A-3", "A", 1, "2023-12-31")])
    keys = spark.createDataFrame([(1, "A")], "project_id long, jira_key string")
    sprints = spark.createDataFrame([(1, "2024-01-01"), (None, "2020-01-01")], "id long, at string").select("id", F.col("at").cast("timestamp").alias("start_date"))
    out = sync.resolve(rows, keys, sprints)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r.jira_issue_id), r.project_id, r.sprint_id, r.added_mid_sprint) for r in out.collect())
    assert got == [("A-1", 1, 1, True), ("A-2", 1, None, False), ("A-3", 1, 1, False), ("B-1", None, 9, False), ("None", None, None, False)]


def test_an_empty_table_is_not_joined(spark):
    none = empty(spark, schemas.ISSUES)
    assert none.schema.simpleString() == schemas.ISSUES.simpleString() and none.count() == 0
    joined = spark.range(3).join(none.select("id"), "id", "full_outer")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_a_micro_batch_do_not_grow_with_the_shuffle_partitions(spark, monkeypatch):
    seen = []
    merge = ingest._merge_buckets
    monkeypatch.setattr(ingest, "_merge_buckets", lambda sp, st, b, incoming, *rest: (seen.append(incoming.rdd.getNumPartitions()), merge(sp, st, b, incoming, *rest)))
    monkeypatch.setattr(history, "known", lambda sp, st, entries, *rest: (seen.append(entries.rdd.getNumPartitions()), empty(sp, schemas.STATUS_HISTORY))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        store = os.path.join(_dir("tasks"), "s")
        pages = landed.changelog_pages(spark, SMOKE_DIR)
        read = landed.as_envelopes(pages).withColumn("seq_file", F.lit("f"))
        ingest.make_batch_writer(store, buckets=2)(read, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 2 and max(seen) <= S.tasks(2) == 8
    assert ingest.read_state(spark, store).count() == pages.select("issue_id").distinct().count()
