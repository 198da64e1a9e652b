"""Folders of the stream's store and the commits that make them visible.

``<kind>/batch=<id>`` holds what a batch wrote; it counts once ``commits``
names it. A repair is a batch of its own that follows the stream's last one.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT_SCHEMA = "batch long, bucket int, kind string, after long, repair int"
#: Ids of repairs start here, beyond those of the stream.
REPAIRS = 1 << 40
#: Tasks that a bucket is dealt over.
TASKS_A_BUCKET = 4


def tasks(buckets: int) -> int:
    """The most tasks that a batch's kept rows are dealt over, whatever the session's shuffle partitions."""
    return buckets * TASKS_A_BUCKET


def read(spark: SparkSession, path: str | list[str], schema) -> DataFrame | None:
    """The rows under ``path``; None where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known to the driver, as one partition and without a Python worker."""
    fields = T.StructType.fromDDL(schema).fields
    made = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields))) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*made)))


def folder(store: str, kind: str, batch: int, bucket: int | None = None) -> str:
    path = os.path.join(store, kind, f"batch={batch}")
    return path if bucket is None else os.path.join(path, f"bucket={bucket}")


def commits(spark: SparkSession, store: str, kind: str, without: int | None = None) -> DataFrame | None:
    rows = read(spark, os.path.join(store, "commits"), COMMIT_SCHEMA)
    if rows is None:
        return None
    rows = rows.where(F.col("kind") == kind)
    return rows if without is None else rows.where(F.col("batch") != without)


def commit(spark: SparkSession, store: str, batch: int, rows: list[tuple[int, str]]) -> None:
    """Make a batch visible: one small file with its (bucket, kind)."""
    after, repair = batch, 0
    if batch >= REPAIRS:
        last = latest(spark, store)
        after, repair = (last[0] if last else -1), batch - REPAIRS + 1
    made = [(batch, bucket, kind, after, repair) for bucket, kind in rows]
    literal_rows(spark, made, COMMIT_SCHEMA).write.mode("append").parquet(os.path.join(store, "commits"))


def latest(spark: SparkSession, store: str) -> tuple[int, int] | None:
    """The last committed batch of the stream (-1 without one), and the number of repairs."""
    rows = read(spark, os.path.join(store, "commits"), COMMIT_SCHEMA)
    row = rows.agg(F.max("after").alias("after"), F.max("repair").alias("repair")).first() if rows is not None else None
    return None if row is None or row.after is None else (row.after, row.repair)


def newest(spark: SparkSession, store: str, kind: str, without: int | None = None) -> list[tuple[int, int]]:
    """(bucket, batch) of the newest commit of each bucket, at most one row a bucket."""
    rows = commits(spark, store, kind, without)
    if rows is None:
        return []
    found = rows.groupBy("bucket").agg(F.max_by("batch", F.struct("after", "repair")).alias("batch"))
    return sorted((r.bucket, r.batch) for r in found.collect())


def committed_rows(spark: SparkSession, store: str, kind: str, schema, commit_kind: str | None = None, without: int | None = None) -> DataFrame | None:
    """All rows that committed batches wrote to ``kind``, with their ``batch``; commits are joined, not listed."""
    made = commits(spark, store, commit_kind or kind, without)
    if made is None:
        return None
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    parts = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
    # Written columns and folder names; a folder without buckets reads a null one.
    have = {f.name for f in fields}
    rows = read(spark, os.path.join(store, kind), T.StructType([*fields, *(p for p in parts if p.name not in have)]))
    return None if rows is None else rows.join(made.select("batch").distinct(), "batch", "left_semi")
