"""Incremental sync of landed issue pages into a versioned silver store.

``readStream`` over the landing folder → per micro-batch: flatten pages,
normalise documents, collapse the batch by key, merge it into only the
buckets its keys hash to, append unseen status history, set broken lines
aside, count what the merge changed and log the run. The trigger is
``availableNow``, so a scheduled job drains whatever has landed and stops.

**Order.** The store keeps, for every key, the landing sequence (pull, page,
file, position) of the version that each column class came from: the last for
overwrite columns, the first for insert-only columns, the first non-NULL one
for each sticky column. A merge takes the greater or smaller sequence, which
is associative and commutative: late, repeated or replayed pages never win,
and the result does not depend on how the stream cuts its batches.

**Commit.** A batch writes new files for its buckets under
``data/batch=<id>`` and then appends one small file to ``commits`` that names
them. Readers follow the newest commit of each bucket, so a crash at any
point leaves the last committed state readable, and a retried batch reads the
state without its own and writes the same folder again. Old bucket versions
stay until ``vacuum`` lists them.

**Repair.** Lines that do not parse are committed with the batch under
``quarantine``. ``repair`` merges mended lines as a batch of its own, by the
sequence that they would have had.

The store holds project keys and sprint ids as landed; ``silver_tables``
resolves them against the projects and sprints (mid-sprint flag included),
imputes story points and gives the same ``Tables`` that the batch sync gives.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import silver, sync, upsert
from ..session import ensure_checkpoint_dir
from ..sources import landed, schemas
from ..sources.tables import Tables, empty
from . import counters, history, runs
from . import store as S

# A batch of k keys rewrites about min(k, BUCKETS) buckets of size
# table / BUCKETS; raise it for very large tables with small batches.
BUCKETS = 256
SPEC = sync.ISSUE_DOCS
SEQ = T.StructType([
    T.StructField("pull", T.LongType()), T.StructField("page", T.LongType()),
    T.StructField("file", T.StringType()), T.StructField("pos", T.IntegerType()),
])
QUARANTINE_SCHEMA = "seq_file string, record string"


def key_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def state_schema() -> T.StructType:
    """Issue rows as landed, with the sequence that each column class came from."""
    kinds = {f.name: f.dataType for f in schemas.ISSUES.fields}
    kinds |= {"project_key": T.StringType(), "last_created": T.TimestampType()}
    names = [SPEC.key, *SPEC.insert_only, *SPEC.overwrite, *SPEC.sticky]
    seqs = ["first_seq", "last_seq", *(f"{c}_seq" for c in SPEC.sticky)]
    return T.StructType([*(T.StructField(n, kinds[n]) for n in names), *(T.StructField(n, SEQ) for n in seqs)])


def committed(spark: SparkSession, store: str, kind: str) -> list[tuple[int, int]]:
    """(bucket, batch) of what readers see: the newest commit of each bucket, at most one row a bucket."""
    return S.newest(spark, store, kind)


def read_state(spark: SparkSession, store: str, only: set[int] | None = None, without: int | None = None) -> DataFrame:
    """The committed issue state, of the buckets ``only`` or of all; ``without``: as if that batch were not committed."""
    paths = [S.folder(store, "data", batch, bucket) for bucket, batch in S.newest(spark, store, "data", without) if only is None or bucket in only]
    return S.read(spark, paths, state_schema()) if paths else empty(spark, state_schema())


def read_appended(spark: SparkSession, store: str, kind: str, schema) -> DataFrame:
    """All committed rows of a kind that only grows: ``history``, ``quarantine``, ``counters``."""
    rows = S.committed_rows(spark, store, kind, schema)
    return empty(spark, schema) if rows is None else rows.drop("batch", "bucket")


def as_state(rows: DataFrame) -> DataFrame:
    """Issue rows of a batch as states of one version each."""
    rows = rows.withColumn("first_seq", F.col("seq").cast(SEQ)).withColumn("last_seq", F.col("first_seq"))
    for c in SPEC.sticky:
        rows = rows.withColumn(f"{c}_seq", F.when(F.col(c).isNotNull(), F.col("first_seq")))
    return rows.select(*state_schema().names)


def merge_states(states: DataFrame) -> DataFrame:
    """One state a key; any order and grouping of the merged states gives the same."""
    g = states.groupBy(SPEC.key).agg(
        F.min_by(F.struct(*SPEC.insert_only), "first_seq").alias("_io"), F.max_by(F.struct(*SPEC.overwrite), "last_seq").alias("_ow"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        *(F.min_by(c, f"{c}_seq").alias(c) for c in SPEC.sticky), *(F.min(f"{c}_seq").alias(f"{c}_seq") for c in SPEC.sticky),
    )
    return g.select(SPEC.key, "_io.*", "_ow.*", *SPEC.sticky, "first_seq", "last_seq", *(f"{c}_seq" for c in SPEC.sticky))


def make_batch_writer(
    store: str, buckets: int = BUCKETS, story_points_field: str = "story_points", ac_field: str = "acceptance_criteria", sprints: DataFrame | None = None
):
    """The ``foreachBatch`` function of the stream; ``sprints(id, start_date)`` tells mid-sprint issues for the counters."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Parsed once, for the rows, the history, the log and the quarantine.
        batch = batch.persist()
        flat = landed.flatten_pages(batch)
        incoming = None
        try:
            pulls = flat.groupBy("pull", "projectKey").agg(F.count(F.lit(1)).alias("issues"))
            with runs.logged(spark, runs.log_dir(store), batch_id, lambda: [(r.pull, r.projectKey, r.issues, None) for r in pulls.collect()]):
                rows = sync.document_rows(flat, story_points_field, ac_field)
                # Kept in tasks by the buckets: a batch's later stages do not grow with the shuffle partitions.
                incoming = merge_states(as_state(rows)).withColumn("bucket", key_bucket(F.col(SPEC.key), buckets)).coalesce(S.tasks(buckets)).persist()
                # At most ``buckets`` small ints reach the driver: the partition filter.
                touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())
                made = [(b, "data") for b in touched]
                if touched:
                    _merge_buckets(spark, store, batch_id, incoming, touched, buckets, sprints)
                    entries = silver.status_history(flat.select(F.col("id").cast("long").alias("issue_id"), "changelog"))
                    history.append(spark, store, entries, buckets, batch_id)
                    made += [(0, "history"), (0, "counters")]
                broken = landed.quarantine(batch) if landed.CORRUPT in batch.columns else None
                if broken is not None and not broken.isEmpty():
                    broken.write.mode("overwrite").parquet(S.folder(store, "quarantine", batch_id))
                    made.append((0, "quarantine"))
                # Everything above is invisible until this one file is there.
                if made:
                    S.commit(spark, store, batch_id, made)
        finally:
            for frame in (incoming, batch):
                if frame is not None:
                    frame.unpersist()

    return write_batch


def _merge_buckets(spark: SparkSession, store: str, batch_id: int, incoming: DataFrame, touched: list[int], buckets: int, sprints: DataFrame | None) -> None:
    """Write the new versions of the touched buckets, and what the merge changed as signed counts."""
    before = read_state(spark, store, set(touched), without=batch_id)
    merged = merge_states(before.unionByName(incoming.drop("bucket"))).withColumn("bucket", key_bucket(F.col(SPEC.key), buckets))
    # Hot buckets are dealt over several tasks, small ones share one.
    dealt = merged.repartition("bucket", F.pmod(F.xxhash64(SPEC.key, F.lit(1)), F.lit(S.TASKS_A_BUCKET)))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(S.folder(store, "data", batch_id))
    after = S.read(spark, [S.folder(store, "data", batch_id, b) for b in touched], state_schema())
    starts = _starts(spark, sprints)
    counters.deltas(before, after, incoming, starts, SPEC.key).write.mode("overwrite").parquet(S.folder(store, "counters", batch_id))


def _starts(spark: SparkSession, sprints: DataFrame | None) -> DataFrame:
    if sprints is None:
        return empty(spark, "sprint_id long, sprint_start timestamp")
    return sprints.select(F.col("id").alias("sprint_id"), F.col("start_date").alias("sprint_start"))


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    """Lines set aside and not repaired yet: (seq_file, record)."""
    aside = read_appended(spark, store, "quarantine", QUARANTINE_SCHEMA)
    done = read_appended(spark, store, "repaired", QUARANTINE_SCHEMA)
    return aside.join(done, ["seq_file", "record"], "left_anti")


def repair(
    spark: SparkSession, store: str, mended: DataFrame, buckets: int = BUCKETS,
    story_points_field: str = "story_points", ac_field: str = "acceptance_criteria", sprints: DataFrame | None = None,
) -> int:
    """Merge mended lines, ``mended(seq_file, record, value)``, of the quarantine; returns the id of the repair.

    Pages take part by the sequence that they name, so a repair that comes late does not win over
    later pages. Lines that still do not parse stay set aside; lines that are not set aside are refused.
    """
    last = S.latest(spark, store)
    batch_id = S.REPAIRS + (last[1] if last else 0)
    known = mended.join(quarantined(spark, store), ["seq_file", "record"], "left_semi").dropDuplicates(["seq_file", "record"]).persist()
    try:
        parsed = landed.parse_lines(known.select("value", "seq_file", "record"), landed.envelope_schema(schemas.issue_doc(story_points_field, ac_field)), keep=("record",))
        good = parsed.where(F.col(landed.CORRUPT).isNull()).persist()
        good.select("seq_file", "record").write.mode("overwrite").parquet(S.folder(store, "repaired", batch_id))
        make_batch_writer(store, buckets, story_points_field, ac_field, sprints)(good.drop("record"), batch_id)
        S.commit(spark, store, batch_id, [(0, "repaired")])
        good.unpersist()
    finally:
        known.unpersist()
    return batch_id


def silver_tables(spark: SparkSession, store: str, projects: DataFrame, sprints: DataFrame, impute: bool = True) -> Tables:
    """The committed state as delivery tables; ``write_tables`` of them is what ``load_tables`` reads."""
    keys = projects.select(F.col("id").alias("project_id"), "jira_key")
    state = read_state(spark, store).drop("first_seq", "last_seq", *(f"{c}_seq" for c in SPEC.sticky))
    issues = sync.resolve(state, keys, sprints)
    if impute:
        issues = silver.impute_story_points(issues)
    have = set(issues.columns)
    issues = issues.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ISSUES.fields])
    log = runs.sync_log(runs.states(spark, runs.log_dir(store)), keys)
    return Tables(projects=projects, sprints=sprints, issues=issues, status_history=history.read_all(spark, store), sync_log=log)


def vacuum(spark: SparkSession, store: str) -> list[str]:
    """Folders of bucket versions that no commit points to any more, for the caller's cleaner."""
    commits = S.commits(spark, store, "data")
    live = set(committed(spark, store, "data"))
    rows = commits.select("bucket", "batch").distinct().collect() if commits is not None else []
    return sorted(S.folder(store, "data", r.batch, r.bucket) for r in rows if (r.bucket, r.batch) not in live)


def run_available(
    spark: SparkSession,
    landing_dir: str,
    store: str,
    checkpoint_dir: str,
    max_files_per_trigger: int = 1000,
    buckets: int = BUCKETS,
    story_points_field: str = "story_points",
    ac_field: str = "acceptance_criteria",
    sprints: DataFrame | None = None,
) -> None:
    """Drain everything landed so far into the store, then stop.

    ``max_files_per_trigger`` bounds each micro-batch; it does not change the
    result. The field parameters are those of the batch sync; ``sprints`` is
    for the mid-sprint counters.
    """
    ensure_checkpoint_dir(spark)
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing_dir)
    schema = landed.envelope_schema(schemas.issue_doc(story_points_field, ac_field))
    stream = landed.parse_lines(lines.select("value", F.input_file_name().alias("seq_file")), schema)
    q = (
        stream.writeStream.foreachBatch(make_batch_writer(store, buckets, story_points_field, ac_field, sprints))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
