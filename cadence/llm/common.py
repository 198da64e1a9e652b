"""Helpers shared by the operators: shared scratch tables, components, pieces of numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ``[\x20\x09-\x0D]``, the white space of every contract; ``bytes.split()`` splits on the same.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch folder only in local runs without it."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so an expensive frame that is used twice is computed
    once and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, by: list, label: str, within: list | None = None) -> DataFrame:
    """``df`` written in the order of ``by`` (then ``within``), with ``_part`` and ``_at``: the part of the order that a row is in, and its place there.

    Parts are ranges of ``by``, so one key may spread over many of them and no
    task gets more than its part; a count by part then gives places in all.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by, *(within or [])).withColumn("_n", F.monotonically_increasing_id())
    return materialise(placed.withColumns({"_part": F.shiftright("_n", 33).cast("int"), "_at": F.col("_n").bitwiseAND((1 << 33) - 1)}).drop("_n"), label)


def held(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, text): the caller's row as one struct, so that no name of its columns meets an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def id_text(col: str = "doc_id"):
    """doc_id as text, for the folds; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


@lru_cache(maxsize=1)
def byte_factors() -> np.ndarray:
    """A fixed odd 64-bit value for each byte, for hashes of byte strings."""
    return np.random.default_rng(20_240).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int, made: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd factor and of its inverse, modulo 2**64."""
    if made.get("n", 0) < n:
        size = 1 << max(14, int(n).bit_length())
        factor = 0x5851F42D4C957F2D
        for name, base in (("up", factor), ("down", pow(factor, -1, 1 << 64))):
            chain = np.full(size, base, dtype=np.uint64)
            chain[0] = 1
            made[name] = np.multiply.accumulate(chain)
        made["n"] = size
    return made["up"], made["down"]


def find_roots(parent: np.ndarray) -> np.ndarray:
    """Full path compression of a parent array."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union by smaller index of the pairs (a, b), vectorised; returns compressed parents."""
    while a.size:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if a.size:
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = find_roots(parent)
    return parent


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): rows (node, root), root the smallest node.

    Minimum labels spread over the edges and jump to the label of their
    label, so rounds grow with the logarithm of the longest path. Every round
    is a written table; each group is a partially aggregated ``min``.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, f"{label}-edges")
    state = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{label}-0")
    step = 0
    while True:
        step += 1
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        spread = state.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = spread.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        after = materialise(jumped, f"{label}-{step}")
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        state = after.select("node", "root")
