"""Set-based upserts of the silver tables.

The reference upserts one document at a time (``INSERT … ON CONFLICT``).
Here a whole batch is merged at once:

1. **collapse** the batch to one row per key, reproducing what sequential
   upserts would leave: *overwrite* columns from the last version,
   *insert-only* columns from the first, *sticky* columns from the first
   non-NULL version;
2. **merge** with the existing table by a full outer join on the key, with
   the same three column classes deciding between existing and incoming.

Both steps shuffle once by key; ``max_by``/``min_by`` aggregate partially,
so a key that appears in a third of the batch is combined map-side.
Plain Parquet has no row-level MERGE, so the result is written as a new
table version by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergeSpec:
    key: str
    overwrite: tuple[str, ...]
    insert_only: tuple[str, ...] = ()
    sticky: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [self.key, *self.insert_only, *self.overwrite, *self.sticky]


# Column classes of the reference's conflict rules (fixed values).
PROJECT_SPEC = MergeSpec(
    key="jira_key",
    overwrite=("name", "description", "lead_email", "jira_project_id", "synced_at"),
    insert_only=("id", "board_id"),
)
SPRINT_SPEC = MergeSpec(
    key="jira_sprint_id",
    overwrite=("name", "state", "goal", "start_date", "end_date", "complete_date", "synced_at"),
    insert_only=("id", "project_id"),
)
ISSUE_SPEC = MergeSpec(
    key="jira_issue_id",
    overwrite=(
        "sprint_id", "status", "status_category", "story_points", "acceptance_criteria", "has_ac",
        "time_spent", "remaining_estimate", "added_mid_sprint", "synced_at",
    ),
    insert_only=(
        "id", "project_id", "issue_type", "priority", "summary", "description", "original_estimate",
        "assignee_email", "reporter_email", "created_at_jira", "updated_at_jira", "due_date",
    ),
    sticky=("in_progress_at", "done_at"),
)


def _present(df: DataFrame, cols: tuple[str, ...]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def collapse_batch(batch: DataFrame, spec: MergeSpec, seq: str = "seq") -> DataFrame:
    """One row per key, as if the batch had been upserted row by row in ``seq`` order."""
    ow = _present(batch, spec.overwrite)
    io = _present(batch, spec.insert_only)
    st = _present(batch, spec.sticky)
    aggs: list[Column] = [F.max(seq).alias(seq)]
    if ow:
        aggs.append(F.max_by(F.struct(*ow), F.col(seq)).alias("_ow"))
    if io:
        aggs.append(F.min_by(F.struct(*io), F.col(seq)).alias("_io"))
    for c in st:
        # NULL order keys are skipped, so this is the first non-NULL value.
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c))
    g = batch.groupBy(spec.key).agg(*aggs)
    cols = [spec.key, *([F.col("_io")[c].alias(c) for c in io]), *([F.col("_ow")[c].alias(c) for c in ow]), *st, seq]
    return g.select(*cols)


def merge(existing: DataFrame, incoming: DataFrame, spec: MergeSpec, as_of: Column | None = None) -> DataFrame:
    """Full-outer merge on ``spec.key``; ``as_of`` stamps ``updated_at`` of touched rows.

    ``incoming`` must hold one row per key, as :func:`collapse_batch` gives it
    (:func:`upsert` does both): a key that came twice would leave two rows.
    """
    e, n = existing.alias("e"), incoming.alias("n")
    j = e.join(n, F.col(f"e.{spec.key}") == F.col(f"n.{spec.key}"), "full_outer")
    in_e = F.col(f"e.{spec.key}").isNotNull()
    in_n = F.col(f"n.{spec.key}").isNotNull()
    ecols, ncols = set(existing.columns), set(incoming.columns)

    def pick(c: str, prefer_new: bool) -> Column:
        ev = F.col(f"e.{c}") if c in ecols else F.lit(None)
        nv = F.col(f"n.{c}") if c in ncols else F.lit(None)
        return F.when(in_n, nv).otherwise(ev) if prefer_new else F.when(in_e, ev).otherwise(nv)

    out = [F.coalesce(F.col(f"e.{spec.key}"), F.col(f"n.{spec.key}")).alias(spec.key)]
    for c in spec.insert_only:
        if c in ecols or c in ncols:
            out.append(pick(c, prefer_new=False).alias(c))
    for c in spec.overwrite:
        if c in ecols or c in ncols:
            out.append(pick(c, prefer_new=True).alias(c))
    for c in spec.sticky:
        if c in ecols or c in ncols:
            ev = F.col(f"e.{c}") if c in ecols else F.lit(None)
            nv = F.col(f"n.{c}") if c in ncols else F.lit(None)
            out.append(F.coalesce(ev, nv).alias(c))
    known = set(spec.columns()) | {"updated_at"}
    for c in existing.columns:
        if c not in known:
            out.append((F.col(f"e.{c}") if c not in ncols else F.coalesce(F.col(f"n.{c}"), F.col(f"e.{c}"))).alias(c))
    if as_of is not None:
        prev = F.col("e.updated_at") if "updated_at" in ecols else F.lit(None).cast("timestamp")
        out.append(F.when(in_n, as_of).otherwise(prev).alias("updated_at"))
    return j.select(*out)


def upsert(existing: DataFrame, batch: DataFrame, spec: MergeSpec, seq: str = "seq", as_of: Column | None = None) -> DataFrame:
    """Collapse the batch, then merge it into ``existing``."""
    incoming = collapse_batch(batch, spec, seq).drop(seq)
    return merge(existing, incoming, spec, as_of)
