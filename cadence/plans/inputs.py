"""Where registered queries get their delivery tables from."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import testdata
from ..sources.tables import Tables, load_tables, write_tables


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Delivery tables planned from the raw test tables by the adapter."""
    return testdata.delivery_tables(spark, sf_dir)


def build_silver(spark: SparkSession, sf_dir: str, root: str) -> Tables:
    """Write the delivery tables once (the ELT step) and give them as Parquet tables."""
    # The order facts feed three tables; keep them for the duration of the
    # writes (recomputed from lineage if an executor is lost).
    facts = testdata.order_facts(spark, sf_dir).persist()
    try:
        write_tables(testdata.delivery_tables(spark, sf_dir, facts), root)
    finally:
        facts.unpersist()
    return load_tables(spark, root)
