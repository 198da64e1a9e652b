"""Append-only status history of the stream's store, pruned by key before it is read.

A batch appends to one part a bucket of the issue id. The index has, for each
part, the range of its times and Bloom filters of its natural keys: one bitmap
for about ``CELL_ROWS`` of its rows, so that filters keep their size's error
however large a part is. A micro-batch reads only parts in which some filter
may hold one of its keys; of entries not seen before, that is hardly any.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import silver
from ..sources import schemas
from ..sources.tables import empty
from . import store as S

KEY = ("issue_id", "from_status", "to_status", "transitioned_at", "author_email")
INDEX_SCHEMA = "batch long, bucket int, cells long, cell long, lo timestamp, hi timestamp, timeless boolean, filter binary"
#: Bits of a filter (a bitmap of Spark's size), hashes of a key, and rows of a part that one filter stands for.
BITS, HASHES, CELL_ROWS = 32_768, 3, 4_096


def issue_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("issue_id"), F.lit(buckets)).cast("int")


def _positions() -> Column:
    return F.array(*(F.pmod(F.xxhash64("h", F.lit(i)), F.lit(BITS)) for i in range(HASHES)))


def _keyed(entries: DataFrame, buckets: int) -> DataFrame:
    return entries.withColumn("bucket", issue_bucket(buckets)).withColumn("h", F.xxhash64(*KEY))


def part_index(rows: DataFrame, batch: int, buckets: int) -> DataFrame:
    """The index rows of the parts that ``rows`` are written to."""
    keyed = _keyed(rows, buckets).select("bucket", "transitioned_at", "h")
    parts = keyed.groupBy("bucket").agg(F.ceil(F.count("*") / CELL_ROWS).cast("long").alias("cells"))
    bits = keyed.join(parts, "bucket").withColumn("cell", F.pmod("h", "cells")).withColumn("at", F.explode(_positions()))
    made = bits.groupBy("bucket", "cells", "cell").agg(
        F.min("transitioned_at").alias("lo"), F.max("transitioned_at").alias("hi"), F.bool_or(F.col("transitioned_at").isNull()).alias("timeless"),
        F.bitmap_construct_agg("at").alias("filter"),
    )
    return made.select(F.lit(batch).cast("long").alias("batch"), "bucket", "cells", "cell", "lo", "hi", "timeless", "filter")


def _holds(filter_: str, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(filter_), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def touched_parts(spark: SparkSession, store: str, entries: DataFrame, buckets: int, batch: int | None = None) -> list[tuple[int, int]]:
    """(batch, bucket) of the committed parts, those of ``batch`` aside, that may hold a key of ``entries``."""
    index = S.committed_rows(spark, store, "history_index", INDEX_SCHEMA, "history", without=batch)
    if index is None:
        return []
    keyed = _keyed(entries, buckets).select("bucket", "transitioned_at", "h")
    span = keyed.groupBy("bucket").agg(F.min("transitioned_at").alias("first"), F.max("transitioned_at").alias("last"), F.bool_or(F.col("transitioned_at").isNull()).alias("some"))
    near = index.join(span, "bucket").where("(lo <= last and hi >= first) or (timeless and some)").drop("first", "last", "some")
    met = keyed.join(near, "bucket").where(
        (F.pmod("h", "cells") == F.col("cell"))
        & (F.col("transitioned_at").between(F.col("lo"), F.col("hi")) | (F.col("transitioned_at").isNull() & F.col("timeless")))
        & F.forall(_positions(), lambda at: _holds("filter", at))
    )
    return sorted((r.batch, r.bucket) for r in met.select("batch", "bucket").distinct().collect())


def known(spark: SparkSession, store: str, entries: DataFrame, buckets: int, batch: int | None = None) -> DataFrame:
    """The committed history of the parts that may hold a key of ``entries``."""
    paths = [S.folder(store, "history", b, bucket) for b, bucket in touched_parts(spark, store, entries, buckets, batch)]
    return (S.read(spark, paths, schemas.STATUS_HISTORY) if paths else None) or empty(spark, schemas.STATUS_HISTORY)


def append(spark: SparkSession, store: str, entries: DataFrame, buckets: int, batch: int) -> None:
    """Write the entries that no committed part holds, and their index; visible when the batch is committed."""
    entries = entries.coalesce(S.tasks(buckets)).persist()
    try:
        new = silver.append_history(known(spark, store, entries, buckets, batch), entries).withColumn("bucket", issue_bucket(buckets))
        # A part a bucket; hot buckets are dealt over several tasks.
        dealt = new.repartition("bucket", F.pmod(F.xxhash64(*KEY), F.lit(S.TASKS_A_BUCKET)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(S.folder(store, "history", batch))
        rows = S.read(spark, S.folder(store, "history", batch), schemas.STATUS_HISTORY)
        if rows is not None:
            part_index(rows, batch, buckets).write.mode("overwrite").parquet(S.folder(store, "history_index", batch))
    finally:
        entries.unpersist()


def read_all(spark: SparkSession, store: str) -> DataFrame:
    """All committed history."""
    rows = S.committed_rows(spark, store, "history", schemas.STATUS_HISTORY, "history")
    return empty(spark, schemas.STATUS_HISTORY) if rows is None else rows.drop("batch", "bucket")


