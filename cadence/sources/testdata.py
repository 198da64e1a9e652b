"""Deterministic mapping of the TPC-H-style test tables onto the delivery schema.

One issue per order, one project per region, one sprint per region and order
month. The same mapping is written independently as DuckDB SQL in
``cadence.plans.oracle`` so every metric can be checked against an oracle.
All work is joins and grouped aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import POINTS
from .tables import Tables

# Fixed values of the mapping (FIXTURES.md §2).
FIRST_YEAR = 1995
ACTIVE_MONTH = 79  # month index of the active sprint; later months are future
SPRINT_DAYS = 14
BACKLOG_EVERY = 7  # o_orderkey % 7 = 0 → no sprint
NULL_POINTS_EVERY = 5
NULL_CATEGORY_EVERY = 11
SECONDS_PER_QUANTITY = 600
PRIORITY_TO_TYPE = {"1-URGENT": "Bug", "2-HIGH": "Story", "3-MEDIUM": "Task", "5-LOW": "Epic"}
STATUS_TO_CATEGORY = {"F": "Done", "P": "In Progress", "O": "To Do"}
EVENT_TO_STATUS = {"click": "In Progress", "view": "To Do", "purchase": "Done", "error": "Resolved"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(c: str) -> Column:
    # Test Parquet holds zone-less times; pin them to UTC instants.
    return F.col(c).cast("timestamp")


def _map(c: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(c == k, v) if out is None else out.when(c == k, v))
    return out


def _month_index(ts: Column) -> Column:
    return (F.year(ts) - FIRST_YEAR) * 12 + F.month(ts)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return r.select(
        F.col("r_regionkey").cast("long").alias("id"),
        F.upper("r_name").alias("jira_key"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("lead_email"),
        F.col("r_regionkey").cast("string").alias("jira_project_id"),
        F.lit(None).cast("long").alias("board_id"),
        F.lit(None).cast("timestamp").alias("synced_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their project (customer → nation → region) and line totals."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    # Pre-aggregate lines per order before the join (map-side partial agg).
    lines = (
        read(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity", "l_linestatus", "l_shipdate")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("q_all"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0.0))).alias("q_done"),
            F.min("l_shipdate").alias("first_ship"),
        )
    )
    geo = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", F.col("r_regionkey").cast("long").alias("project_id"), "r_name")
    )
    od = _ts("o_orderdate")
    return (
        orders.join(geo, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("od", od)
        .withColumn("m", _month_index(od))
        .withColumn("month_start", F.date_trunc("MONTH", od))
    )


def _sprint_state(m: Column) -> Column:
    return F.when(m > ACTIVE_MONTH, "future").when(m == ACTIVE_MONTH, "active").otherwise("closed")


def sprints_from(facts: DataFrame) -> DataFrame:
    s = facts.groupBy("project_id", "r_name", "m", "month_start").agg(F.count(F.lit(1)).alias("_n"))
    sid = F.col("project_id") * 1000 + F.col("m")
    state = _sprint_state(F.col("m"))
    return s.select(
        sid.cast("long").alias("id"),
        sid.cast("long").alias("jira_sprint_id"),
        "project_id",
        F.concat(F.col("r_name"), F.lit(" Sprint "), F.col("m").cast("string")).alias("name"),
        state.alias("state"),
        F.lit(None).cast("string").alias("goal"),
        F.col("month_start").alias("start_date"),
        (F.col("month_start") + F.make_dt_interval(F.lit(SPRINT_DAYS))).alias("end_date"),
        F.when(state == "closed", F.add_months(F.col("month_start"), 1).cast("timestamp")).alias("complete_date"),
        F.lit(None).cast("timestamp").alias("synced_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def issues_from(facts: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    backlog = (k % BACKLOG_EVERY) == 0
    sprint_id = F.when(~backlog, F.col("project_id") * 1000 + F.col("m")).cast("long")
    sprint_start = F.when(~backlog, F.col("month_start"))
    status = _map(F.col("o_orderstatus"), STATUS_TO_CATEGORY)
    category = F.when((F.col("o_orderstatus") == "O") & ((k % NULL_CATEGORY_EVERY) == 0), F.lit(None)).otherwise(status)
    points = F.when((k % NULL_POINTS_EVERY) == 0, F.lit(None)).otherwise(((k % 13) + 1).cast(POINTS) * F.lit(0.5).cast(POINTS))
    created = F.col("od") - F.make_dt_interval((k % 30).cast("int"))
    ac = F.when(k % 3 == 0, F.lit("AC")).when(k % 3 == 1, F.lit("  "))
    estimate = (F.col("q_all") * SECONDS_PER_QUANTITY).cast("long")
    spent = (F.col("q_done") * SECONDS_PER_QUANTITY).cast("long")
    return facts.select(
        k.cast("long").alias("id"),
        F.concat(F.upper("r_name"), F.lit("-"), k.cast("string")).alias("jira_issue_id"),
        "project_id",
        sprint_id.alias("sprint_id"),
        _map(F.col("o_orderpriority"), PRIORITY_TO_TYPE).alias("issue_type"),
        F.col("o_orderpriority").alias("priority"),
        status.alias("status"),
        category.alias("status_category"),
        F.concat(F.lit("Order "), k.cast("string")).alias("summary"),
        F.lit(None).cast("string").alias("description"),
        ac.alias("acceptance_criteria"),
        F.coalesce(F.trim(ac) != "", F.lit(False)).alias("has_ac"),
        points.cast(POINTS).alias("story_points"),
        estimate.alias("original_estimate"),
        spent.alias("time_spent"),
        (estimate - spent).alias("remaining_estimate"),
        F.col("c_name").alias("assignee_email"),
        F.lit(None).cast("string").alias("reporter_email"),
        created.alias("created_at_jira"),
        F.lit(None).cast("timestamp").alias("updated_at_jira"),
        F.when(F.col("o_orderstatus") != "O", F.col("od")).alias("in_progress_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("first_ship").cast("timestamp")).alias("done_at"),
        F.lit(None).cast("date").alias("due_date"),
        F.coalesce(created > sprint_start, F.lit(False)).alias("added_mid_sprint"),
        F.lit(None).cast("timestamp").alias("synced_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def sync_log_from(facts: DataFrame) -> DataFrame:
    y = F.year("od")
    g = facts.groupBy("project_id", y.alias("year")).agg(
        F.max("od").alias("started_at"),
        F.count(F.lit(1)).alias("issues_synced"),
        F.count_distinct("m").alias("sprints_synced"),
    )
    return g.select(
        (F.col("project_id") * 10000 + F.col("year")).cast("long").alias("id"),
        "project_id",
        F.lit("full").alias("sync_type"),
        F.when(F.col("year") % 3 == 0, "failed").otherwise("success").alias("status"),
        "issues_synced",
        "sprints_synced",
        F.lit(None).cast("string").alias("error_message"),
        "started_at",
        F.col("started_at").alias("finished_at"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flat change-log items: one row per event, in event_id order per user."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.col("user_id").cast("long").alias("issue_id"),
        F.col("event_id").cast("long").alias("seq"),
        _ts("ts").alias("transitioned_at"),
        F.when(F.col("event_type") == "signup", "labels").otherwise("status").alias("field"),
        prior_status(F.col("event_id")).alias("from_status"),
        F.when(F.col("event_type") == "signup", F.lit("new-user")).otherwise(_map(F.col("event_type"), EVENT_TO_STATUS)).alias("to_status"),
        F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string"), F.lit("@example.org")).alias("author_email"),
    )


def prior_status(event_id: Column) -> Column:
    """Deterministic ``fromString`` for a change item (the events carry none)."""
    r = event_id % 3
    return F.when(r == 0, "To Do").when(r == 1, "In Progress").otherwise("Done")


def delivery_tables(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> Tables:
    """The five delivery tables, each planned only when first used."""
    cache: dict[str, DataFrame] = {}

    def f() -> DataFrame:
        if "facts" not in cache:
            cache["facts"] = facts if facts is not None else order_facts(spark, sf_dir)
        return cache["facts"]

    return Tables(
        projects=lambda: projects(spark, sf_dir),
        sprints=lambda: sprints_from(f()),
        issues=lambda: issues_from(f()),
        status_history=lambda: status_events(spark, sf_dir).filter(F.col("field") == "status").drop("seq", "field"),
        sync_log=lambda: sync_log_from(f()),
    )
