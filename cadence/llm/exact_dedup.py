"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space (``[\\x20\\x09-\\x0D]``).
Of equal texts the row with the most code points, then the smallest doc_id stays.

Defined cases: a null text counts as empty, and all empty texts are equal; a
null doc_id never wins over another id; rows that repeat a doc_id with an equal
text get equal result rows (``keep_rows`` keeps one of them); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, held, materialise, text_or_empty

#: Code points of the normalised text in the prefix hash.
PREFIX_CHARS = 64
REFINED = ["norm_chars", "prefix_hash"]
#: Parts into which the rows of one key are dealt where texts move.
SALTS = 16


def normalised(col: str = "text"):
    return F.regexp_replace(text_or_empty(col), SPACE + "+", "")


def _signed(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """Narrow columns of the first two levels, beside the normalised text."""
    kept = [c for c in ("row", "doc_id") if c in docs.columns]
    base = docs.select(*kept, F.length(text_or_empty()).alias("n_chars"), normalised().alias("norm"))
    return base.select(
        *kept, "n_chars", "norm",
        F.length("norm").alias("norm_chars"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix_hash"),
    )


def _refined(narrow: DataFrame) -> DataFrame:
    """Keys (length, prefix hash) that more than one row has, among lengths that more than one row has.

    Rows are counted by both first, so that a very common length or text is
    one row of a task before anything is joined or shuffled by it.
    """
    pairs = narrow.groupBy(*REFINED).agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("norm_chars").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("norm_chars")
    return pairs.where("n > 1").join(lengths, "norm_chars", "left_semi").select(*REFINED)


def _dealt(signed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a key, and those that meet none; under a salt, so that copies of one text spread."""
    salted = signed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return tuple(salted.join(spread, [*REFINED, "salt"], how) for how in ("left_semi", "left_anti"))


def _best():
    """doc_id of the row that stays; ``~`` reverses the order of long integers without overflow."""
    return F.max_by("doc_id", F.struct("n_chars", F.bitwise_not("doc_id")))


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, n_chars, text_sha256), one for each row of ``docs``.

    The full hash is taken only where length and prefix hash meet another
    row's; ``text_sha256`` of the others is null, unless ``digest_all`` asks
    for the digest of every row. Groups are partially aggregated before the
    shuffle; the join back is one that AQE splits when a group is hot.
    """
    signed = _signed(docs, prefix_chars)
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    if digest_all:
        # One reading of the texts; the levels below read the narrow rows.
        rows = materialise(signed.select("doc_id", "n_chars", *REFINED, digest.alias("text_sha256")), "exact-rows")
        keys = _refined(rows)
        hashed = rows
    else:
        keys = _refined(signed)
        met, alone = _dealt(signed, keys)
        hashed = met.select("doc_id", "n_chars", *REFINED, digest.alias("text_sha256"))
        rows = hashed.unionByName(alone.select("doc_id", "n_chars", *REFINED, F.lit(None).cast("string").alias("text_sha256")))
    best = _best()
    groups = (
        hashed.groupBy(*REFINED, "text_sha256")
        .agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .join(keys, REFINED, "left_semi")
    )
    return rows.join(groups, [*REFINED, "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "n_chars",
        "text_sha256",
    )


def keep_rows(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    Rows whose length and prefix hash no other row has stay unread; the others are hashed in full.
    """
    signed = _signed(held(docs), prefix_chars).drop("norm")
    met, alone = _dealt(signed, materialise(_refined(signed), "exact-keys"))
    hashed = met.select("row", "doc_id", "n_chars", F.sha2(normalised("row.text").cast("binary"), 256).alias("sha"))
    best = hashed.groupBy("sha").agg(_best().alias("keep_id"))
    # Repeated rows of one document share id and text.
    kept = hashed.join(best.withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.select("row").unionByName(kept.dropDuplicates(["sha"]).select("row")).select("row.*")
