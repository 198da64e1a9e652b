"""Conversation prefix trie: nodes, members and subtree sums of all distinct prefixes.

Turns are hashed once. The digest of a prefix is the XOR of hashes of (place,
turn), three words of 64 bits: associative, so that a running digest needs no
conversation whole. Distinct prefixes are nodes, counted by partial
aggregation; two words name a node, and the third must be equal in all
conversations that meet there.

Subtrees are summed in shards. A node's subtree has at most as many nodes as
the turns that its members have below it, which the counting sums on the way.
Subtrees of at most ``shard_nodes`` go to shards whole, by the digest of their
top; nodes above them are the crown. A shard gives its digests the slots of a
minimal perfect hash table, verified by the digests held in the slots, scatters
counts into flat arrays by slot and adds them through the array of parent slots
in depth order. The crown, where sums of whole shards meet, is summed by
doubling: in each round a node adds what stands 2**k below it.

Defined cases: turns are ordered by turn (null first), then role, then text;
repeated turns are turns of their own; a null role or text counts as empty;
rows without a conv_id belong to no conversation and make no node; an empty
table has no node; a text or a conversation of any length is one; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, materialise

#: Nodes of a shard, about; a subtree with more turns below it is split.
SHARD_NODES = 100_000
#: Places of a conversation whose running digest one task makes.
CELL = 4_096
KEY = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, a, b, c, n_bytes): turns by their place from 1, their text as hashes and a length.

    Rows are numbered by their place in the order of all, less that of the
    first of the conversation, so that a long conversation spreads over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    start = F.substring("text", 1, 32)
    placed = in_order(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), start], "trie-turns", within=[F.col("text")])
    pieces = placed.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    words = [F.xxhash64(F.lit(k), "role", "text").alias(k) for k in "abc"]
    return placed.join(pieces, ["conv_id", "_part"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("place"), *words, F.octet_length("text").cast("long").alias("n_bytes"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, k1, k2, k3, p1, p2, n_bytes): the digest of each prefix and of the one before it."""
    of = [F.xxhash64("place", *"abc", F.lit(k)).alias(f"x{k}") for k in (1, 2, 3)]
    rows = turns.select("conv_id", F.col("place").cast("long").alias("depth"), "n_bytes", *of, F.floor(F.col("place") / CELL).alias("cell"))
    cells = rows.groupBy("conv_id", "cell").agg(*(F.bit_xor(f"x{k}").alias(f"s{k}") for k in (1, 2, 3)))
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv_id", "cell", *(F.bit_xor(f"s{k}").over(before).alias(f"s{k}") for k in (1, 2, 3))).where("cell > 0")
    upto = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({f"r{k}": F.bit_xor(f"x{k}").over(upto) for k in (1, 2, 3)}).join(cells, ["conv_id", "cell"], "left")
    # A conversation whose first places lie in a later cell has nothing before them.
    digests = running.withColumns({f"k{k}": F.col(f"r{k}").bitwiseXOR(F.coalesce(f"s{k}", F.lit(0))) for k in (1, 2, 3)})
    return digests.select("conv_id", "depth", "k1", "k2", "k3", *(F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)), "n_bytes")


def _nodes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (depth, k1, k2, p1, p2, conv_id, n_convs, n_bytes, below) of the distinct prefixes, the root included."""
    long = rows.join(ids, "conv_id").withColumn("below", F.col("n_turns") - F.col("depth") + 1)
    found = long.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.sum("below").alias("below"), ((F.min("k3") != F.max("k3")) | (F.min("n_bytes") != F.max("n_bytes"))).alias("met"),
    )
    clash = F.when(F.col("met"), F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, "p1", "p2")]
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("below"))
    root = root.where("n_convs > 0").select(*zero, "conv_id", "n_convs", "n_bytes", "below")
    return found.withColumn("below", F.coalesce(clash, "below")).drop("met").unionByName(root)


class SlotTable:
    """Minimal perfect hash of distinct digests: each gets a slot below their number.

    A level hashes what is left into twice as many cells; digests alone in
    their cell get the next slots, the others go to the next level. ``find``
    verifies a slot by the digest that holds it, so others find nothing.
    """

    LEVELS = 200

    def __init__(self, digests: np.ndarray) -> None:
        self.held = np.zeros_like(digests)
        self.levels: list[np.ndarray] = []
        left, used = np.arange(len(digests)), 0
        while left.size:
            if len(self.levels) == self.LEVELS:
                raise ValueError("digests are not distinct")
            cells = np.full(max(64, 2 * left.size), -1, dtype=np.int64)
            at = self._cell(digests[left], len(self.levels), len(cells))
            alone = np.bincount(at, minlength=len(cells))[at] == 1
            slots = used + np.arange(alone.sum())
            cells[at[alone]] = slots
            self.held[slots] = digests[left[alone]]
            self.levels.append(cells)
            left, used = left[~alone], used + slots.size

    @staticmethod
    def _cell(digests: np.ndarray, level: int, cells: int) -> np.ndarray:
        x = digests[:, 1] ^ (digests[:, 0] * np.uint64(2 * level + 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + digests[:, 2]
        return ((x ^ (x >> np.uint64(29))) % np.uint64(cells)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slots of ``digests``, -1 of those without one."""
        slots = np.full(len(digests), -1, dtype=np.int64)
        left = np.arange(len(digests))
        for level, cells in enumerate(self.levels):
            got = cells[self._cell(digests[left], level, len(cells))]
            # An empty slot is held by none: index 0 stands in and fails the check of got.
            right = (got >= 0) & (self.held[np.maximum(got, 0)] == digests[left]).all(axis=1)
            slots[left[right]] = got[right]
            left = left[~right]
        return slots


def _shard_sums(table: pa.Table) -> pa.Table:
    """Adds to the nodes of whole subtrees their parents' conv_id, children, leaves and saved bytes."""
    own = {c: table.column(c).to_numpy() for c in table.column_names}
    u = lambda c: own[c].astype(np.int64).view(np.uint64)
    digests = np.stack([u("k1"), u("k2"), own["depth"].astype(np.uint64)], axis=1)
    above = np.stack([u("p1"), u("p2"), (own["depth"] - 1).astype(np.uint64)], axis=1)
    slots = SlotTable(digests)
    mine = slots.find(digests)
    n = len(mine)
    row_of = np.empty(n, dtype=np.int64)
    row_of[mine] = np.arange(n)
    # Flat arrays by slot.
    depth, parent = own["depth"][row_of], slots.find(above)[row_of]
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    saved = ((own["n_convs"] - 1) * own["n_bytes"])[row_of]
    deep = np.argsort(-depth, kind="stable")
    for level in np.split(deep, np.flatnonzero(np.diff(depth[deep])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = parent[mine]
    parents = pa.array(own["conv_id"][row_of][np.maximum(up, 0)], mask=up < 0)
    columns = [table.column(c) for c in (*KEY, "p1", "p2", "conv_id", "n_convs")]
    return pa.Table.from_arrays([*columns, parents, *(pa.array(x[mine].astype(np.int64)) for x in (children, leaves, saved))], [c for c, _ in SUMMED])


SUMMED = [(c, "long") for c in (*KEY, "p1", "p2", "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens")]


def _crown_sums(crown: DataFrame, tops: DataFrame) -> DataFrame:
    """The sums of the nodes above the shards, from their own and those of the shards' top nodes."""
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    under = tops.select(*up, "n_leaves", "saved_tokens").unionByName(
        crown.where("depth > 0").select(*up, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    )
    under = under.groupBy(*KEY).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    own = crown.join(under.withColumnsRenamed({"saved_tokens": "_s", "n_leaves": "_l"}), KEY, "left")
    childless = F.col("n_children").isNull()
    nodes = own.select(
        *KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(childless, 1).otherwise(F.col("_l")).cast("long").alias("n_leaves"),
        (F.coalesce("_s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
        F.when(F.col("depth") > 0, F.struct(*up)).alias("over"),
    )
    nodes, step = materialise(nodes, "trie-crown-0"), 0
    while not nodes.where("over is not null").isEmpty():
        step += 1
        # ``over`` is the node 2 ** (step - 1) above; sums hold what is less far below.
        more = nodes.where("over is not null").groupBy("over").agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        added = nodes.join(more.select("over.*", "_l", "_s"), KEY, "left")
        jump = nodes.select(F.struct(*KEY).alias("over"), F.col("over").alias("_far"))
        added = added.join(jump, "over", "left").select(
            *KEY, "p1", "p2", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens"), F.col("_far").alias("over"),
        )
        nodes = materialise(added, f"trie-crown-{step}")
    return nodes.drop("over")


def _ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (depth, k1, k2, ends_sha256) of the nodes at which conversations end.

    Members are sorted by node and conv_id over all tasks; runs of them become
    pieces of text, whose bytes one task hashes in order, holding one piece.
    """
    last = rows.join(ids.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*KEY, "conv_id")
    last = last.unionByName(ids.where("n_turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ids = batch.column(3).to_numpy()
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(ids)] if len(ids) else [0]
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, cut[1:])]
            at = np.array(cut[:-1], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(ids[at]), pa.array(text, pa.string())], [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            made: list[tuple] = []
            for *node, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node == key:
                    sha.update(b"," + text.encode())
                    continue
                if key is not None:
                    made.append((*key, sha.hexdigest()))
                key, sha = node, hashlib.sha256(text.encode())
            if made:
                yield _ended(made)
        if key is not None:
            yield _ended([(*key, sha.hexdigest())])

    by = [*KEY, "conv_id"]
    cut = last.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each node.

    ``turns`` are rows as of ``turn_rows`` with places from 1 without gaps;
    ``ids`` names the conversations, those without turns too.
    """
    rows = materialise(prefixes(turns), "trie-prefixes")
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    if ids is not None:
        counts = ids.select("conv_id").distinct().join(counts, "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"))
    ids = materialise(counts, "trie-ids")
    nodes = materialise(_nodes(rows, ids), "trie-nodes")
    above = F.col("depth") == 0
    wide = nodes.where((F.col("below") > shard_nodes) & ~above).select(*KEY)
    # Along a conversation the crown comes first: below the cut its subtree is small.
    cuts = rows.join(wide, KEY).groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    cuts = ids.join(cuts, "conv_id", "left").select("conv_id", F.coalesce("cut", F.lit(1)).cast("long").alias("cut"))
    tops = rows.join(cuts, "conv_id").where("depth = cut").select("conv_id", "cut", F.xxhash64("k1", "k2", "depth").alias("top"))
    small = nodes.where(~above).join(tops, "conv_id").where("depth >= cut")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = small.select(F.pmod("top", F.lit(shards)).alias("shard"), *KEY, "p1", "p2", "conv_id", "n_convs", "n_bytes")
    schema = ", ".join(f"{c} {t}" for c, t in SUMMED)
    summed = materialise(dealt.groupBy("shard").applyInArrow(_shard_sums, schema), "trie-sums")
    crown = nodes.where(above).unionByName(nodes.where(~above).join(wide, KEY, "left_semi"))
    crown = materialise(_crown_sums(crown, summed.where("parent_conv_id is null")), "trie-crown")
    over = crown.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_above"))
    every = summed.unionByName(crown.withColumn("parent_conv_id", F.lit(None).cast("long")))
    every = every.join(over, ["depth", "p1", "p2"], "left").join(_ends(rows, ids), KEY, "left")
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
