"""Landed source documents: issue pages with change logs, as JSON.

The tracker's REST API returns pages in three envelope styles
(``startAt/total``, ``isLast`` and ``nextPageToken``); once landed as JSON
lines they are read with a fixed schema and flattened into one item
sequence keyed by ``(file, page, pos)``.

For the test tables, change-log pages are derived from ``events``: each
event is one history entry of issue ``user_id``. Entries are grouped into
pages of at most ``page_size`` by ``event_id`` block, so no issue's whole
history is ever gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .testdata import EVENT_TO_STATUS, STATUS_TO_CATEGORY, _map, prior_status, read

PAGE_SIZE = 4096  # upper bound of history entries per landed document
#: Codec of landed lines, which repeat their field names; a compressed file is read by one task.
LANDED_CODEC = "lz4"


def render_ts(ts: Column, variant: Column) -> Column:
    """Render an instant as landed text; ``variant`` 0–3 are accepted shapes, 4 is malformed."""
    return (
        F.when(variant == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSZ"))
        .when(variant == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(variant == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")))
        .when(variant == 3, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm"))
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed history entry per event (created text in one of five shapes)."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ts = F.col("ts").cast("timestamp")
    status_item = F.struct(
        F.lit("status").alias("field"),
        prior_status(F.col("event_id")).alias("fromString"),
        _map(F.col("event_type"), EVENT_TO_STATUS).alias("toString"),
    )
    label_item = F.struct(
        F.lit("labels").alias("field"), F.lit(None).cast("string").alias("fromString"),
        F.lit("new-user").alias("toString"),
    )
    return e.select(
        F.col("user_id").cast("long").alias("issue_id"),
        F.col("event_id").cast("long").alias("seq"),
        "event_type",
        "value",
        ts.alias("ts"),
        render_ts(ts, F.col("event_id") % 5).alias("created"),
        F.struct(F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string"), F.lit("@example.org")).alias("emailAddress")).alias("author"),
        F.array(F.when(F.col("event_type") == "signup", label_item).otherwise(status_item)).alias("items"),
    )


def changelog_pages(spark: SparkSession, sf_dir: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Issue documents, one per (issue, change-log page), fields as of the page's last entry.

    Each group holds at most ``page_size`` events (event ids are unique), so
    ``collect_list`` is bounded however hot one issue is.
    """
    ch = event_changes(spark, sf_dir).withColumn("page", F.floor(F.col("seq") / page_size).cast("long"))
    entry = F.struct("seq", "created", "author", "items")
    seq = F.col("seq")
    # Only the history entries travel in the list; the page's first/last
    # values come from min_by/max_by, which aggregate partially.
    g = ch.groupBy("issue_id", "page").agg(
        F.sort_array(F.collect_list(entry)).alias("h"),
        F.struct(F.max_by("event_type", seq).alias("event_type"), F.max_by("value", seq).alias("value"),
                 F.max_by("created", seq).alias("created"), F.max_by("author", seq).alias("author")).alias("last"),
        F.struct(F.min_by("created", seq).alias("created"), F.min_by("author", seq).alias("author")).alias("first"),
    )
    last = F.col("last")
    first = F.col("first")
    status = _map(last["event_type"], {**EVENT_TO_STATUS, "signup": "To Do"})
    category = _map(status, {"In Progress": "In Progress", "To Do": "To Do", "Done": "Done", "Resolved": "Done"})
    fields = F.struct(
        F.concat(F.lit("Event issue "), F.col("issue_id").cast("string")).alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.struct(F.lit("Task").alias("name")).alias("issuetype"),
        F.struct(F.lit("Medium").alias("name")).alias("priority"),
        F.struct(status.alias("name"), F.struct(category.alias("name")).alias("statusCategory")).alias("status"),
        last["author"].alias("assignee"),
        first["author"].alias("reporter"),
        first["created"].alias("created"),
        last["created"].alias("updated"),
        F.lit(None).cast("string").alias("duedate"),
        F.lit(None).cast("long").alias("timeoriginalestimate"),
        F.lit(None).cast("long").alias("timespent"),
        F.lit(None).cast("long").alias("timeestimate"),
        F.floor(last["value"]).cast("long").cast("string").alias("story_points"),
        F.lit(None).cast("string").alias("acceptance_criteria"),
    )
    changelog = F.struct(
        (F.col("page") * page_size).alias("startAt"),
        F.transform("h", lambda x: F.struct(x["created"].alias("created"), x["author"].alias("author"), x["items"].alias("items"))).alias("histories"),
    )
    return g.select(
        F.col("issue_id").cast("string").alias("id"),
        F.concat(F.lit("EV-"), F.col("issue_id").cast("string")).alias("key"),
        "issue_id",
        "page",
        fields.alias("fields"),
        changelog.alias("changelog"),
    )


# ── page envelopes ───────────────────────────────────────────────────────────

CORRUPT = "_corrupt_record"

def envelope_schema(item: T.StructType) -> T.StructType:
    """Union of the three envelope styles; only one item array is set per page."""
    return T.StructType([
        T.StructField("startAt", T.LongType()),
        T.StructField("maxResults", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("isLast", T.BooleanType()),
        T.StructField("nextPageToken", T.StringType()),
        # The token that the puller asked for this page with; none for a first page.
        T.StructField("pageToken", T.StringType()),
        T.StructField("issues", T.ArrayType(item)),
        T.StructField("values", T.ArrayType(item)),
        # Landing context written by the puller: landing sequence of the page,
        # the project it was pulled for, and the sprint (NULL for backlog).
        T.StructField("page", T.LongType()),
        T.StructField("projectKey", T.StringType()),
        T.StructField("sprintId", T.LongType()),
        # Number of the pull that landed the page; a ``pull=<n>`` folder sets it too.
        T.StructField("pull", T.LongType()),
        T.StructField(CORRUPT, T.StringType()),
    ])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed JSON lines with their file; a line that does not parse keeps its text in ``_corrupt_record``.

    A ``pull=<n>`` folder gives the pull of lines that do not name one.
    """
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    folder = [F.col("pull").cast("long").alias("_folder")] if "pull" in lines.columns else []
    read = lines.select(parsed.alias("_doc"), F.input_file_name().alias("seq_file"), *folder).select("_doc.*", "seq_file", *[F.col("_folder")] * len(folder))
    return read.withColumn("pull", F.coalesce("pull", "_folder")).drop("_folder") if folder else read


def parse_lines(lines: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Like :func:`read_json` for rows ``lines(value, seq_file)``, of a stream or of mended lines; a ``pull=<n>`` folder is read off the file's path."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    folder = F.regexp_extract("seq_file", r"/pull=(\d+)/", 1).try_cast("long")
    # An empty line is no record.
    rows = lines.where(F.trim("value") != "").select(parsed.alias("_doc"), "seq_file", folder.alias("_folder"), *keep)
    return rows.select("_doc.*", "seq_file", "_folder", *keep).withColumn("pull", F.coalesce("pull", "_folder")).drop("_folder")


def write_json(df: DataFrame, path: str, max_records_per_file: int = 0) -> None:
    """Land documents as compressed JSON lines; 0 records: a file is what a task writes."""
    df.write.mode("overwrite").option("compression", LANDED_CODEC).option("maxRecordsPerFile", max_records_per_file).json(path)


def quarantine(read: DataFrame) -> DataFrame:
    """The lines of :func:`read_json` that did not parse: (seq_file, record)."""
    return read.where(F.col(CORRUPT).isNotNull()).select("seq_file", F.col(CORRUPT).alias("record"))


def read_pages(spark: SparkSession, path: str, item: T.StructType | None = None) -> DataFrame:
    """Read landed page envelopes and flatten them to one row per item.

    ``seq_file``, ``seq_page`` and ``seq_pos`` give the landing order used by
    the last-wins / first-wins rules of the upsert.
    """
    return flatten_pages(read_json(spark, path, envelope_schema(item or schemas.issue_doc())))


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row per item. ``seq`` is its landing order: pull, page, file, position; absent parts come first."""
    items = F.coalesce(F.col("issues"), F.col("values"))
    ctx = [c for c in ("projectKey", "sprintId", "pull") if c in pages.columns]
    flat = pages.select(
        "seq_file", F.col("page").alias("seq_page"), *ctx, F.posexplode_outer(items).alias("seq_pos", "doc")
    ).filter(F.col("doc").isNotNull())
    pull = F.coalesce(F.col("pull"), F.lit(0).cast("long")) if "pull" in ctx else F.lit(0).cast("long")
    seq = F.struct(pull.alias("pull"), F.col("seq_page").alias("page"), F.col("seq_file").alias("file"), F.col("seq_pos").alias("pos"))
    return flat.select("seq_file", "seq_page", "seq_pos", *[c for c in ctx if c != "pull"], pull.alias("pull"), seq.alias("seq"), "doc.*")


def as_envelopes(docs: DataFrame, style: Column | None = None) -> DataFrame:
    """Wrap issue documents one per page in one of the three envelope styles (for landing).

    ``docs`` needs ``page`` (landing sequence) and may carry ``projectKey`` /
    ``sprintId`` context columns.
    """
    style = style if style is not None else (F.col("page") % 3)
    doc = F.struct(*[c for c in ("id", "key", "fields", "changelog") if c in docs.columns])
    arr = F.array(doc)
    ctx = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("projectKey", "string"), ("sprintId", "long"), ("pull", "long"))]
    return docs.select(
        F.col("page"),
        *ctx,
        F.when(style == 0, F.col("page")).alias("startAt"),
        F.lit(1).cast("long").alias("maxResults"),
        F.when(style == 0, F.col("page") + 1).alias("total"),
        F.when(style == 1, F.lit(False)).alias("isLast"),
        F.when(style == 2, F.concat(F.lit("t"), F.col("page").cast("string"))).alias("nextPageToken"),
        F.when(style != 1, arr).alias("issues"),
        F.when(style == 1, arr).alias("values"),
    )


__all__ = [
    "CORRUPT", "PAGE_SIZE", "STATUS_TO_CATEGORY", "as_envelopes", "changelog_pages", "event_changes",
    "flatten_pages", "parse_lines", "quarantine", "read_json", "read_pages", "render_ts", "write_json",
]
