"""Tables bucketed by their merge key, so that a merge moves only the batch.

A table written by :func:`write_bucketed` holds each key's rows in the bucket
of the key's hash. :func:`merge_bucketed` joins a batch to it bucket by bucket:
the batch is shuffled to the table's buckets, the table is read where it lies,
and each task writes its bucket of the new version. Buckets grow with the table,
so choose their number for its size (table bytes / 256 MB or so); a key stands
in the table once, so buckets are even whatever the data.

Versions are tables of the session catalog, named by the caller; the caller
drops the former one once no reader needs it. Rows with a null key match nothing
and are kept, each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.upsert import MergeSpec, collapse_batch, merge


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Deal ``df`` into ``buckets`` by ``key``, one file each, as table ``name``; returns it as read back."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    _save(df.repartition(buckets, key), name, key, buckets, path)
    return df.sparkSession.table(name)


def buckets_of(spark: SparkSession, name: str) -> tuple[str, int]:
    """(key, number of buckets) of a table of :func:`write_bucketed`."""
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    if "Num Buckets" not in facts:
        raise ValueError(f"{name} is not bucketed")
    return facts["Bucket Columns"].strip("[]").replace("`", ""), int(facts["Num Buckets"])


def merge_bucketed(
    spark: SparkSession, name: str, batch: DataFrame, spec: MergeSpec, as_of: Column, into: str, seq: str | None = None, path: str | None = None,
) -> DataFrame:
    """Merge ``batch`` into table ``name`` by ``spec`` as the new table ``into``, with the same buckets.

    ``as_of`` stamps the rows that the batch touches. With ``seq`` the batch is collapsed to one row per key first; without, it
    must hold one row per key.
    """
    key, buckets = buckets_of(spark, name)
    if key != spec.key:
        raise ValueError(f"{name} is bucketed by {key}, the merge is by {spec.key}")
    merged = merge_plan(spark, name, batch, spec, as_of, seq)
    _save(merged, into, key, buckets, path)
    return spark.table(into)


def merge_plan(spark: SparkSession, name: str, batch: DataFrame, spec: MergeSpec, as_of: Column, seq: str | None = None) -> DataFrame:
    """The merged rows, each in the task of its bucket; the columns of the table come first."""
    _, buckets = buckets_of(spark, name)
    if seq is not None:
        batch = collapse_batch(batch, spec, seq).drop(seq)
    existing = spark.table(name)
    merged = merge(existing, batch.repartition(buckets, spec.key), spec, as_of)
    ordered = [c for c in existing.columns if c in merged.columns]
    return merged.select(*ordered, *[c for c in merged.columns if c not in ordered])


def _save(df: DataFrame, name: str, key: str, buckets: int, path: str | None) -> None:
    writer = df.write.format("parquet").mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
