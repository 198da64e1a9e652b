"""The delivery tables as DataFrames, plus Parquet load/write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

TABLE_SCHEMAS = {
    "projects": schemas.PROJECTS,
    "sprints": schemas.SPRINTS,
    "issues": schemas.ISSUES,
    "status_history": schemas.STATUS_HISTORY,
    "sync_log": schemas.SYNC_LOG,
}


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A frame without rows that the optimizer knows to be empty, so joins with it are not planned."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    none = spark.range(1, numPartitions=1).where(F.lit(False))
    return none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


class Tables:
    """The delivery tables, planned lazily.

    Each table may be given as a ``DataFrame`` or a zero-argument callable
    returning one; a callable runs on first access, so a metric that uses
    two tables never lists or plans the other three.
    """

    NAMES = ("projects", "sprints", "issues", "status_history", "sync_log")

    def __init__(self, projects=None, sprints=None, issues=None, status_history=None, sync_log=None):
        self._src = {
            "projects": projects, "sprints": sprints, "issues": issues,
            "status_history": status_history, "sync_log": sync_log,
        }
        self._cache: dict[str, DataFrame | None] = {}

    def _get(self, name: str) -> DataFrame | None:
        if name not in self._cache:
            v = self._src[name]
            self._cache[name] = v() if callable(v) and not isinstance(v, DataFrame) else v
        return self._cache[name]

    projects = property(lambda self: self._get("projects"))
    sprints = property(lambda self: self._get("sprints"))
    issues = property(lambda self: self._get("issues"))
    status_history = property(lambda self: self._get("status_history"))
    sync_log = property(lambda self: self._get("sync_log"))

    def with_(self, **changes) -> "Tables":
        return Tables(**{**self._src, **changes})

    def names(self) -> list[str]:
        return [n for n in self.NAMES if self._src[n] is not None]


def load_tables(spark: SparkSession, root: str) -> Tables:
    """Read a silver layer written by :func:`write_tables` (one folder per table)."""

    def reader(name: str):
        return lambda: spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}")

    return Tables(**{name: reader(name) for name in TABLE_SCHEMAS})


def write_tables(tables: Tables, root: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Write each table to ``root/<name>`` (a new version folder; Parquet has no MERGE).

    ``issues`` is partitioned by ``project_id`` so per-project metrics prune
    files instead of scanning every project (the reference used an index).
    The data is deliberately *not* repartitioned by ``project_id`` first:
    each task writes its own files into the partition folders, so a project
    holding a third of all issues is written by many tasks, and
    ``maxRecordsPerFile`` bounds file size.
    """
    for name in tables.names():
        df: DataFrame = getattr(tables, name)
        writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
        if name == "issues":
            writer = writer.partitionBy("project_id")
        writer.parquet(f"{root}/{name}")
