"""Table constraints re-aimed as data-quality audits.

PostgreSQL enforced keys, NOT NULL, CHECK and foreign keys on write; on
Parquet they become audits that count violating rows. Each check is one
aggregate or anti-join; the report is one ``(check_name, table_name,
bad_rows)`` frame built by ``unionByName`` (no driver-side loop over data).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(check: str, table: str, bad: DataFrame) -> DataFrame:
    return bad.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.col("bad_rows").cast("long"))


def row_checks(
    df: DataFrame,
    table: str,
    not_null: Sequence[str] = (),
    domains: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """All per-row rules of one table (NOT NULL, CHECK … IN) in a single pass.

    One global aggregate of conditional counts, turned into one report row
    per rule with ``inline`` — the table is scanned once, not once per rule.
    """
    rules: list[tuple[str, F.Column]] = [(f"not_null({c})", F.col(c).isNull()) for c in not_null]
    for c, values in (domains or {}).items():
        rules.append((f"domain({c})", ~F.col(c).isin(*list(values))))
    if not rules:
        raise ValueError("no row rules given")
    counts = df.agg(*[F.count(F.when(cond, 1)).alias(f"_r{n}") for n, (_, cond) in enumerate(rules)])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.lit(table).alias("table_name"), F.col(f"_r{n}").cast("long").alias("bad_rows"))
        for n, (name, _) in enumerate(rules)
    ])
    return counts.select(F.inline(rows))


def unique(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Rows beyond the first per key (0 when the key is unique); keys with a NULL never clash, as in SQL."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bad = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad_rows"))
    return _row(f"unique({','.join(keys)})", table, bad)


def not_null(df: DataFrame, col: str, table: str) -> DataFrame:
    bad = df.agg(F.count(F.when(F.col(col).isNull(), 1)).alias("bad_rows"))
    return _row(f"not_null({col})", table, bad)


def domain(df: DataFrame, col: str, values: Iterable[str], table: str) -> DataFrame:
    """CHECK (col IN (…)); NULL passes, as in SQL."""
    vals = list(values)
    bad = df.agg(F.count(F.when(~F.col(col).isin(*vals), 1)).alias("bad_rows"))
    return _row(f"domain({col})", table, bad)


def foreign_key(child: DataFrame, cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str], table: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent row (left anti join)."""
    c = child.select(*cols)
    for x in cols:
        c = c.filter(F.col(x).isNotNull())
    # Pre-aggregate per key value: a value carried by a third of the child
    # rows becomes one row before the join shuffle.
    c = c.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(*[F.col(pc).alias(cc) for pc, cc in zip(parent_cols, cols)]).distinct()
    bad = c.join(p, list(cols), "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("bad_rows"))
    return _row(f"foreign_key({','.join(cols)})", table, bad)


@dataclass(frozen=True)
class Rules:
    """The constraints of one table. ``foreign`` maps columns to (parent table, its key column)."""

    not_null: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)


# The constraints of the delivery tables (fixed values).
DELIVERY_RULES = {
    "projects": Rules(not_null=("jira_key", "name"), unique=(("jira_key",),)),
    "sprints": Rules(
        not_null=("jira_sprint_id", "project_id", "name", "state"), domains={"state": ("future", "active", "closed")},
        unique=(("jira_sprint_id",),), foreign={"project_id": ("projects", "id")},
    ),
    "issues": Rules(
        not_null=("jira_issue_id", "project_id", "status", "summary", "added_mid_sprint"), unique=(("jira_issue_id",),),
        foreign={"sprint_id": ("sprints", "id"), "project_id": ("projects", "id")},
    ),
    "status_history": Rules(not_null=("issue_id", "to_status", "transitioned_at"), foreign={"issue_id": ("issues", "id")}),
    "sync_log": Rules(
        not_null=("sync_type", "status", "started_at"), domains={"status": ("running", "success", "failed")},
        foreign={"project_id": ("projects", "id")},
    ),
}


def _listed(tables: dict[str, Rules]) -> list[tuple[str, str, str, tuple[str, ...]]]:
    """(check name, table, kind, columns) of every rule; its place is the rule's number."""
    out = []
    for table, r in tables.items():
        out += [(f"not_null({c})", table, "row", (c,)) for c in r.not_null] + [(f"domain({c})", table, "row", (c,)) for c in r.domains]
        out += [(f"unique({','.join(k)})", table, "unique", tuple(k)) for k in r.unique] + [(f"foreign_key({c})", table, "foreign", (c,)) for c in r.foreign]
    return out


def _cells(df: DataFrame, rules: Rules, listed: list[tuple[int, str, str, tuple[str, ...]]]) -> DataFrame:
    """Rows (rule, key, n) of one table from one pass over it.

    Each row gives a cell for every row rule that it breaks and every key that
    it holds; cells are counted by rule and key, so a key of a third of the
    rows is one cell of a task.
    """
    found = []
    for number, check, kind, columns in listed:
        if kind == "row":
            holds = F.col(columns[0]).isNull() if check.startswith("not_null") else ~F.col(columns[0]).isin(*rules.domains[columns[0]])
            key = F.lit("")
        else:
            holds = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
            key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])
        found.append(F.when(holds, F.struct(F.lit(number).alias("rule"), key.alias("key"))))
    rows = df.select(F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.*")
    return rows.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


def audit(tables: dict[str, DataFrame], rules: dict[str, Rules]) -> DataFrame:
    """(check_name, table_name, bad_rows) of every rule, each table read once (parents' keys once more)."""
    listed = [(n, *rule) for n, rule in enumerate(_listed(rules))]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    cells = union([_cells(tables[table], r, [(n, check, kind, c) for n, check, t, kind, c in listed if t == table]) for table, r in rules.items()])
    parents = [
        tables[parent].select(F.lit(n).alias("rule"), F.col(key).cast("string").alias("key"))
        for n, _, table, kind, columns in listed if kind == "foreign" for parent, key in [rules[table].foreign[columns[0]]]
    ]
    # The cells are already dealt out by (rule, key), so this join moves only the parents.
    if parents:
        cells = cells.join(union(parents).distinct().withColumn("known", F.lit(True)), ["rule", "key"], "left")
    else:
        cells = cells.withColumn("known", F.lit(None).cast("boolean"))
    is_ = lambda kind: F.col("rule").isin([n for n, _, _, k, _ in listed if k == kind])
    bad = F.when(is_("unique"), F.col("n") - 1).when(is_("foreign"), F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).otherwise(F.col("n"))
    bad = cells.select("rule", bad.alias("n"))
    every = cells.sparkSession.createDataFrame([(n, check, table) for n, check, table, _, _ in listed], "rule int, check_name string, table_name string")
    sums = bad.groupBy("rule").agg(F.sum("n").alias("bad"))
    return every.join(sums, "rule", "left").select("check_name", "table_name", F.coalesce("bad", F.lit(0)).cast("long").alias("bad_rows"))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    out = None
    for c in checks:
        out = c if out is None else out.unionByName(c)
    if out is None:
        raise ValueError("no checks given")
    return out
