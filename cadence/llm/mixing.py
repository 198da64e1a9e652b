"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

A source's target is its share by weight, at most ``most`` times its size; what
that leaves over is shared among the others by weight until none is above. Of
a target, whole epochs of the source come first; the rest is a budget of words,
filled by the documents of the smallest hashes. Words are summed by source and
hash bucket, the bucket in which the running sum passes the budget is found,
and only its documents are summed again by their next bits, until it holds one
hash. So thresholds are nested (a larger budget takes the same documents and
more), nothing is sorted, and a filter by threshold takes the mix. The document
at the threshold is taken in part, so that a source meets its target exactly.

Sources are ordered by code point, null last, and weights repeat in that order.

Defined cases: a null text has no words and an empty text none; a null source
is a source; rows of one doc_id (or without) share a hash, and at the threshold
share what is left in proportion to their sizes, rounded down; a table without
words has targets of 0; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, materialise

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits of it that a histogram resolves at a time.
HASH_BITS, STEP = 60, 12


def hashed(seed: str = "mix") -> Column:
    """A hash of doc_id, ``HASH_BITS`` bits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, s, no_source, size, h); s and no_source join null sources too."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id", source.alias("source"), F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("no_source"), size.alias("size"), hashed(seed).alias("h")
    )


KEY = ["s", "no_source"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (s, no_source, source_size, target) of all sources of ``sizes``."""
    sources = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    placed = in_order(sources, [F.col("no_source"), F.col("s")], "mix-sources")
    # A row for each part of the order, however many sources there are.
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_at")) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (place + 1).cast("int"))
    cap = (F.col("source_size") * most).alias("cap")
    sources = materialise(placed.join(parts, "_part").select(*KEY, "source_size", weight.alias("weight"), cap), "mix-targets")
    first = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("free")).first()
    budget, full, free = share * first.words, 0, first.free
    while True:
        by_weight = (F.lit(budget - full) * F.col("weight") / F.lit(float(max(free, 1)))).cast("double")
        capped = F.col("cap") <= by_weight
        now = sources.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("free")).first()
        if now.free == 0 or (now.full, now.free) == (full, free):
            return sources.select(*KEY, "source_size", F.when(capped, F.col("cap")).otherwise(by_weight).cast("double").alias("target"))
        full, free = now.full, now.free


def quotas(targets: DataFrame) -> DataFrame:
    """Adds the whole copies of every document, and the words that remain to be taken."""
    words = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    return targets.withColumn("copies", copies.cast("long")).withColumn("rest", words - F.col("copies") * F.col("source_size"))


def thresholds(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (s, no_source, edge, remain, edge_size) of the sources with words.

    Documents of a smaller hash than ``edge`` are taken; those of that hash,
    ``edge_size`` words in all, have ``remain`` words taken of them.
    """
    inside = sizes.where("size > 0").select(*KEY, "size", "h")
    budget = sources.select(*KEY, F.col("rest").alias("remain"))
    done = []
    for level in range(-(-HASH_BITS // STEP)):
        bucket = F.shiftright("h", HASH_BITS - STEP * (level + 1))
        sums = inside.groupBy(*KEY, bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        # At most 2 ** STEP rows a source.
        running = F.sum("sum").over(Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        upto = sums.withColumn("upto", running).join(budget, KEY).where("upto > remain and upto - sum <= remain")
        found = materialise(upto.select(*KEY, "bucket", "lo", "hi", "sum", (F.col("remain") - F.col("upto") + F.col("sum")).alias("remain")), f"mix-edge-{level}")
        done.append(found.where("lo = hi").select(*KEY, F.col("lo").alias("edge"), "remain", F.col("sum").alias("edge_size")))
        wide = found.where("lo < hi")
        if wide.isEmpty():
            break
        budget = wide.select(*KEY, "remain")
        inside = materialise(inside.withColumn("bucket", bucket).join(wide.select(*KEY, "bucket"), [*KEY, "bucket"]).drop("bucket"), f"mix-inside-{level}")
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    return edges


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, part), one for each row of ``docs``.

    The mix takes ``copies`` whole copies of a document, and the first ``part``
    words of one more.
    """
    sizes = materialise(sized(docs, seed), "mix-sizes")
    sources = materialise(quotas(targets(sizes, weights, share, most)), "mix-quotas")
    plan = sources.join(thresholds(sizes, sources), KEY, "left")
    rows = sizes.join(plan, KEY)
    shared = F.expr("cast(cast(size as decimal(19,0)) * cast(remain as decimal(19,0)) div edge_size as bigint)")
    below, at = F.col("h") < F.col("edge"), F.col("h") == F.col("edge")
    # A document at the edge is never taken whole beside its copies: remain < edge_size.
    copies = F.col("copies") + F.when(below, 1).otherwise(0)
    part = F.when(at, shared).otherwise(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), part.alias("part"))
