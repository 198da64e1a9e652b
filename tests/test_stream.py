"""The stream's history pruning, counters, quarantine, repairs and run log; page chains; deep rich text."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cadence.functions import text as X
from cadence.operators import completeness, listing, metrics, silver
from cadence.plans import ingest_queries
from cadence.sources import landed, schemas
from cadence.sources.tables import Tables
from cadence.streaming import counters, history, ingest, runs
from cadence.streaming import store as S
from tests.conftest import SMOKE_DIR


def _dir(label):
    return tempfile.mkdtemp(prefix=f"cadence-{label}-")


def _entries(spark, rows):
    made = [(i, "To Do", to, f"2024-01-{day:02d} 00:00:00" if day else None, None) for i, to, day in rows]
    return spark.createDataFrame(made, "issue_id long, from_status string, to_status string, at string, author_email string").select(
        "issue_id", "from_status", "to_status", F.col("at").cast("timestamp").alias("transitioned_at"), "author_email"
    )


def _append(spark, store, rows, batch, buckets=4):
    history.append(spark, store, _entries(spark, rows), buckets, batch)
    S.commit(spark, store, batch, [(0, "history")])


def test_history_reads_only_parts_that_may_hold_a_key(spark):
    store = _dir("history")
    for batch in range(3):
        _append(spark, store, [(i, "Done", batch * 5 + 1 + i % 3) for i in range(200)], batch)
    assert history.read_all(spark, store).count() == 600
    # Of another time, or of the same times with other keys: no part is read.
    for rows in ([(i, "Done", 28) for i in range(200)], [(i, "Closed", 6 + i % 3) for i in range(50)]):
        assert len(history.touched_parts(spark, store, _entries(spark, rows), 4)) <= (0 if rows[0][2] == 28 else 2)
    # One entry that the second batch has: its bucket of that batch, no other.
    one = _entries(spark, [(7, "Done", 1 * 5 + 1 + 7 % 3)])
    bucket = one.select(history.issue_bucket(4).alias("b")).first().b
    assert history.touched_parts(spark, store, one, 4) == [(1, bucket)]
    files = history.known(spark, store, one, 4).inputFiles()
    assert files and all(f"batch=1/bucket={bucket}/" in f for f in files)
    # Seen entries are not appended again, new ones and timeless ones once.
    _append(spark, store, [(7, "Done", 6 + 7 % 3), (7, "Done", None), (999, "Done", 1)], 3)
    _append(spark, store, [(7, "Done", None)], 4)
    assert history.read_all(spark, store).count() == 602
    assert history.read_all(spark, store).where("transitioned_at is null").count() == 1


def test_history_filters_grow_with_their_part(spark, monkeypatch):
    monkeypatch.setattr(history, "CELL_ROWS", 16)
    store = _dir("cells")
    _append(spark, store, [(i, "Done", 1 + i % 20) for i in range(400)], 0, buckets=2)
    index = S.committed_rows(spark, store, "history_index", history.INDEX_SCHEMA, "history").collect()
    assert all(r.cells > 8 for r in index) and len(index) > 16
    assert history.touched_parts(spark, store, _entries(spark, [(i, "Done", 1 + i % 20) for i in range(400)]), 2) == [(0, 0), (0, 1)]


def _moves(spark):
    place = (F.col("issue_id") + F.col("page")) % 5
    pages = landed.changelog_pages(spark, SMOKE_DIR, page_size=64).withColumn("projectKey", F.concat(F.lit("P"), F.col("issue_id") % 2))
    return landed.as_envelopes(pages.withColumn("sprintId", F.when(place != 0, place))).withColumn("seq_file", F.lit("f"))


def test_counters_of_deltas_equal_the_batch_metrics(spark):
    env = _moves(spark)
    projects = spark.createDataFrame([(0, "P0", "a"), (1, "P1", "b")], "id long, jira_key string, name string")
    starts = spark.range(5).select("id", (F.col("id") % 2).alias("project_id"), F.timestamp_seconds(F.lit(1_704_300_000) + F.col("id") * 86400).alias("start_date"))
    store = os.path.join(_dir("counters"), "s")
    writer = ingest.make_batch_writer(store, buckets=4, sprints=starts)
    for n, pick in ((0, 2), (1, 0), (2, 1), (2, 1)):  # later pages first, the last batch twice
        writer(env.where(F.col("page") % 3 == pick), n)
    counted = counters.read(spark, store)
    again = counters.total(counters.cells(ingest.read_state(spark, store), ingest._starts(spark, starts)))
    assert sorted(map(str, counted.collect())) == sorted(map(str, again.collect()))
    t = ingest.silver_tables(spark, store, projects, starts)
    want = metrics._sprint_issue_agg(t.issues, starts.select(F.col("id").alias("sprint_id"))).collect()
    got = counters.sprint_counters(counted).groupBy("sprint_id").agg(*(F.sum(c).alias(c) for c in want[0].asDict() if c != "sprint_id")).collect()
    assert {tuple(float(r[c]) for c in want[0].asDict()) for r in want} == {tuple(float(r[c]) for c in want[0].asDict()) for r in got}
    backlog = {(r.project_key, r.issue_type): (r.total_issues, r.with_criteria) for r in counters.backlog_counters(counted).collect()}
    assert backlog == {(f"P{r.project_id}", r.issue_type): (r["count"], r.with_ac) for r in metrics.backlog_by_type(t).collect()}
    assert sum(r.n for r in counted.collect()) == t.issues.count()


@pytest.mark.parametrize("files", [1, 1000])
def test_quarantine_and_repair(spark, files):
    root = _dir("repair")
    landing, store, ckpt = (os.path.join(root, x) for x in ("landing", "store", "ckpt"))
    doc = '{"pull":1,"page":%d,"projectKey":"A","issues":[{"id":"%d","key":"A-%d","fields":{"summary":"s","status":{"name":"%s"}}}]}'
    lines = [doc % (1, 1, 1, "first"), (doc % (2, 1, 1, "second"))[:-9], doc % (3, 1, 1, "third"), (doc % (4, 2, 2, "only"))[:-9], "not json", ""]
    for n, line in enumerate(lines):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(os.path.join(landing, f"part={n}"))
    ingest.run_available(spark, os.path.join(landing, "*"), store, ckpt, files, buckets=4)
    aside = ingest.quarantined(spark, store).collect()
    assert len(aside) == 3 and {r.jira_issue_id: r.status for r in ingest.read_state(spark, store).collect()} == {"A-1": "third"}
    fixed = [(r.seq_file, r.record, next((x for x in (doc % (2, 1, 1, "second"), doc % (4, 2, 2, "only")) if x.startswith(r.record)), "still broken")) for r in aside]
    unknown = [("elsewhere", "x", doc % (9, 1, 1, "never"))]
    ingest.repair(spark, store, spark.createDataFrame(fixed + unknown, "seq_file string, record string, value string"), buckets=4)
    # The mended page of an issue does not win over the page landed after it.
    assert {r.jira_issue_id: r.status for r in ingest.read_state(spark, store).collect()} == {"A-1": "third", "A-2": "only"}
    assert [r.record for r in ingest.quarantined(spark, store).collect()] == ["not json"]
    # The stream goes on after a repair, and a repair after that.
    spark.createDataFrame([(doc % (5, 3, 3, "new"),), ("{",)], "value string").coalesce(1).write.text(os.path.join(landing, "part=9"))
    ingest.run_available(spark, os.path.join(landing, "*"), store, ckpt, files, buckets=4)
    assert ingest.read_state(spark, store).count() == 3 and ingest.quarantined(spark, store).count() == 2
    late = [(r.seq_file, r.record, doc % (6, 1, 1, "fourth")) for r in ingest.quarantined(spark, store).where("record = '{'").collect()]
    ingest.repair(spark, store, spark.createDataFrame(late, "seq_file string, record string, value string"), buckets=4)
    assert {r.jira_issue_id: r.status for r in ingest.read_state(spark, store).collect()} == {"A-1": "fourth", "A-2": "only", "A-3": "new"}


def test_failed_batch_is_logged_and_its_retry_succeeds(spark, monkeypatch):
    env, store = _moves(spark), os.path.join(_dir("runs"), "s")
    projects = spark.createDataFrame([(0, "P0", "a"), (1, "P1", "b"), (2, "P2", "c")], "id long, jira_key string, name string")
    keys = projects.select(F.col("id").alias("project_id"), "jira_key")
    writer = ingest.make_batch_writer(store, buckets=4)
    with monkeypatch.context() as broken:
        broken.setattr(history, "append", lambda *a: (_ for _ in ()).throw(OSError("disk gone")))
        with pytest.raises(OSError):
            writer(env, 0)
    log = runs.sync_log(runs.states(spark, runs.log_dir(store)), keys).collect()
    assert {(r.project_id, r.status, r.error_message, r.issues_synced) for r in log} == {(p, "failed", "OSError: disk gone", 0) for p in (0, 1)}
    assert ingest.read_state(spark, store).count() == 0
    meta = lambda: {r.jira_key: r.last_sync_ok for r in listing.project_sync_meta(Tables(
        projects=projects.withColumn("synced_at", F.lit(None).cast("timestamp")), sync_log=runs.sync_log(runs.states(spark, runs.log_dir(store)), keys))).collect()}
    assert meta() == {"P0": None, "P1": None, "P2": None}
    writer(env, 0)
    assert all(v is not None for k, v in meta().items() if k != "P2") and meta()["P2"] is None
    log = runs.sync_log(runs.states(spark, runs.log_dir(store)), keys).collect()
    assert {r.status for r in log} == {"success"} and sum(r.issues_synced for r in log) == env.count()
    assert all(r.started_at <= r.finished_at for r in log)
    # A batch that began and never ended is running.
    runs.record(spark, [(5, "P0", None, None)], runs.log_dir(store), 9, "running")
    assert [r.status for r in runs.sync_log(runs.states(spark, runs.log_dir(store)), keys).where("finished_at is null").collect()] == ["running"]


def test_stream_takes_configured_fields_and_pull_folders(spark):
    root = _dir("fields")
    landing, store = os.path.join(root, "landing", "pull=7"), os.path.join(root, "store")
    line = '{"page":1,"projectKey":"A","issues":[{"id":"1","key":"A-1","fields":{"summary":"s","cf_1":"5","cf_2":"Given x"}}]}'
    spark.createDataFrame([(line,)], "value string").write.text(landing)
    ingest.run_available(spark, landing, store, os.path.join(root, "ckpt"), buckets=2, story_points_field="cf_1", ac_field="cf_2")
    r = ingest.read_state(spark, store).first()
    assert (float(r.story_points), r.acceptance_criteria, r.last_seq.pull) == (5.0, "Given x", 7)


def _chain(spark, pages):
    fields = landed.envelope_schema(schemas.issue_doc())
    rows = [{"pull": p.get("pull", 0), "projectKey": p.get("key"), **{k: v for k, v in p.items() if k not in ("pull", "key", "n")}, "issues": [{"id": "x"}] * p["n"] if p["n"] is not None else None} for p in pages]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").withColumn("seq_file", F.lit("f"))
    return {tuple(r) for r in completeness.missing_pages(landed.parse_lines(lines, fields)).select("pull", "projectKey", "style", "kind", "from_item", "to_item", "token").collect()}


def test_page_chains(spark, monkeypatch):
    monkeypatch.setattr(completeness, "CELL", 10)
    assert _chain(spark, [{"startAt": 0, "total": 4, "n": 2}, {"startAt": 2, "total": 4, "n": 2}, {"startAt": 2, "total": 4, "n": 2}]) == set()
    # A long page covers several cells; a gap between cells, a tail, and a total that grew.
    pages = [{"startAt": 0, "total": 60, "n": 35}, {"startAt": 5, "total": 60, "n": 1}, {"startAt": 41, "total": 61, "n": 9}]
    assert _chain(spark, pages) == {(0, None, "total", "gap", 35, 41, None), (0, None, "total", "tail", 50, 61, None)}
    assert _chain(spark, [{"startAt": 0, "isLast": False, "n": 3, "key": "A"}]) == {(0, "A", "isLast", "open", 3, None, None)}
    assert _chain(spark, [{"startAt": 0, "isLast": False, "n": 3}, {"startAt": 3, "isLast": True, "n": 0}]) == set()
    assert _chain(spark, [{"startAt": 2, "isLast": True, "n": None}]) == {(0, None, "isLast", "gap", 0, 2, None)}
    tokens = [{"nextPageToken": "a", "n": 1}, {"pageToken": "a", "nextPageToken": "b", "n": 1}, {"pageToken": "c", "n": 1}, {"pull": 1, "pageToken": "a", "n": 1}]
    assert _chain(spark, tokens) == {(0, None, "token", "token", None, None, "b"), (1, None, "token", "first", None, None, None)}
    assert _chain(spark, [{"nextPageToken": None, "n": 0}]) == set()


def test_missing_pages_of_nothing_and_of_broken_lines(spark):
    lines = spark.createDataFrame([("{",), ("",)], "value string").withColumn("seq_file", F.lit("f"))
    assert completeness.missing_pages(landed.parse_lines(lines, landed.envelope_schema(schemas.issue_doc()))).collect() == []


def test_stream_queries_give_the_same_for_any_batches(spark):
    for query, few in ((ingest_queries.stream_repair, 3),):
        assert sorted(map(str, query(spark, SMOKE_DIR, few).collect())) == sorted(map(str, query(spark, SMOKE_DIR, 1000).collect()))


def _nested(depth):
    return '{"content":[' * depth + '{"text":"deep","attrs":{"text":"no"}}' + "]}" * depth


@pytest.mark.parametrize("depth", [1, 2_000, 20_000, 200_000])
def test_rich_text_of_any_depth(spark, depth):
    assert X.rich_text(_nested(depth)) == "deep"
    rows = spark.createDataFrame([(_nested(depth),)], "doc string")
    assert rows.select(X.extract_text_exact("doc")).first()[0] == "deep"


def test_deep_rich_text_agrees_with_the_parser():
    docs = ['{"text":"a\\u00e9\\n\\ud83d\\ude00","content":[{"text":"b"},[],{"text":"c","content":[1,2.50,true,false,null,"x"]}]}', "[1e3, -0, 12345678901234567890]",
            '{"content":null,"text":""}', '{"a":1,"a":2,"text":"last","text":"wins"}', "[]", "{}", ' [ "x" , { } ] ', '"text"', "12"]
    broken = ["[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", '["\\x"]', '["\t"]', "[1]]", "[", "{]", "[tru]", "[01]", "[1.]", '{1:2}', "nul", '["a', "[ 1]", "[1", '{"a":}', "[,1]", "[-]"]
    for doc in docs + broken:
        try:
            want = json.loads(doc)
        except ValueError:
            with pytest.raises(ValueError):
                X.parse_deep(doc)
        else:
            assert X.parse_deep(doc) == want and str(X.parse_deep(doc)) == str(want)


def test_silver_history_is_unchanged(spark):
    pages = landed.changelog_pages(spark, SMOKE_DIR)
    store = os.path.join(_dir("same"), "s")
    entries = silver.status_history(pages)
    history.append(spark, store, entries, 4, 0)
    S.commit(spark, store, 0, [(0, "history")])
    assert sorted(map(str, history.read_all(spark, store).collect())) == sorted(map(str, entries.collect()))
