"""Completeness of landed page chains: what a pull should have landed and did not.

A chain is the pages of one pull and project in one envelope style. Pages that
name ``startAt`` must cover every item from 0 to the largest ``total`` that any
of them names, or, where pages carry ``isLast``, up to a closing page. Pages
linked by tokens must have been requested by every ``nextPageToken`` that a
page names, and begin with one requested without a token.

Covers are computed by cells of ``CELL`` items: the farthest end before a cell
comes from one row a cell, and only the pages of one cell are sorted together.
Overlapping and repeated pages are fine; a page without items covers nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["pull", "projectKey", "style"]
CELL = 100_000


def page_rows(pages: DataFrame) -> DataFrame:
    """Landed envelopes as rows (pull, projectKey, style, start, end, total, last, asked, next)."""
    style = F.when(F.col("total").isNotNull(), "total").when(F.col("isLast").isNotNull(), "isLast").otherwise("token")
    n = F.coalesce(F.size(F.coalesce("issues", "values")), F.lit(0))
    start = F.coalesce("startAt", F.lit(0))
    return pages.select(
        F.coalesce("pull", F.lit(0)).cast("long").alias("pull"), "projectKey", style.alias("style"), start.alias("start"), (start + n).alias("end"),
        "total", "isLast", F.col("pageToken").alias("asked"), F.col("nextPageToken").alias("next"),
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    joined = left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], how)
    return joined.drop(*(f"_r_{c}" for c in keys))


def missing_ranges(rows: DataFrame) -> DataFrame:
    """Rows (pull, projectKey, style, kind, from_item, to_item) of items that no page covers; without an end where no page closes the chain."""
    placed = rows.where("style <> 'token'").withColumn("cell", F.floor(F.col("start") / CELL))
    before = Window.partitionBy(*CHAIN).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*CHAIN, "cell").agg(F.max("end").alias("far")).select(*CHAIN, "cell", F.coalesce(F.max("far").over(before), F.lit(0)).alias("far"))
    earlier = Window.partitionBy(*CHAIN, "cell").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = placed.withColumn("near", F.max("end").over(earlier))
    reached = _null_safe(reached, cells, [*CHAIN, "cell"], "inner").withColumn("reach", F.greatest("far", F.coalesce("near", F.lit(0))))
    gaps = reached.where("start > reach").select(*CHAIN, F.lit("gap").alias("kind"), F.col("reach").alias("from_item"), F.col("start").alias("to_item"))
    ends = placed.groupBy(*CHAIN).agg(F.max("end").alias("end"), F.max("total").alias("total"), F.bool_or("isLast").alias("closed"))
    tails = ends.where("total > end").select(*CHAIN, F.lit("tail").alias("kind"), F.col("end").alias("from_item"), F.col("total").alias("to_item"))
    opens = ends.where("style = 'isLast' and not closed").select(*CHAIN, F.lit("open").alias("kind"), F.col("end").alias("from_item"), F.lit(None).cast("long").alias("to_item"))
    return gaps.distinct().unionByName(tails).unionByName(opens)


def missing_tokens(rows: DataFrame) -> DataFrame:
    """Rows (pull, projectKey, style, kind, token): tokens that pages name and no page was requested by, and chains without a first page."""
    linked = rows.where("style = 'token'")
    asked = linked.where("asked is not null").select(*CHAIN, F.col("asked").alias("token")).distinct()
    named = linked.where("next is not null").select(*CHAIN, F.col("next").alias("token")).distinct()
    lost = _null_safe(named, asked, [*CHAIN, "token"], "left_anti").select(*CHAIN, F.lit("token").alias("kind"), "token")
    first = linked.groupBy(*CHAIN).agg(F.bool_or(F.col("asked").isNull()).alias("begun")).where("not begun")
    return lost.unionByName(first.select(*CHAIN, F.lit("first").alias("kind"), F.lit(None).cast("string").alias("token")))


def missing_pages(pages: DataFrame) -> DataFrame:
    """All that is missing from the chains of landed envelopes (rows of ``landed.read_json``)."""
    rows = page_rows(pages.where(F.col("_corrupt_record").isNull()))
    none = lambda kind: F.lit(None).cast(kind)
    ranges = missing_ranges(rows).withColumn("token", none("string"))
    tokens = missing_tokens(rows).withColumns({"from_item": none("long"), "to_item": none("long")})
    return ranges.unionByName(tokens)
