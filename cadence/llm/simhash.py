"""SimHash near-dedup with vantage-point trees.

Fingerprints are 64-bit majority votes over the hashes of word shingles. A
vantage-point tree, chosen on a bounded sample, deals every distinct
fingerprint to one leaf by its Hamming distances to the vantage points. The
triangle inequality bounds which other leaves can hold a partner within the
link distance; the fingerprint also visits those, later ones only, so every
pair of leaves is met once. A leaf of more residents than a block gets a tree
of its own, chosen on a bounded sample of its residents, and so on until every
leaf fits a block: leaves grow in proportion to the fingerprints, and a level is
one shuffle of the leaves that are too large. A leaf whose sample no vantage
point divides is cut into blocks, each compared with those before it.

What visits a block is dealt into slices, and each slice is compared with all
residents of the block, so a task holds at most a block and a slice. There, rows
are ordered by the distance to a resident, which prunes the comparison to a
band. Every slice returns a spanning forest of its links, not its pairs, and the
forests are joined into components.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; texts shorter than a shingle hash their whole word sequence; a null
doc_id is never a component's id while another exists; repeated rows share a
fingerprint; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, find_roots, held, materialise, slices, text_or_empty, unite

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A tree is chosen on about so many fingerprints, picked by a hash.
SAMPLE = 16_384
#: Sampled fingerprints of a leaf, residents of a block, visitors of a slice.
LEAF_SAMPLE, BLOCK, SLICE = 64, 8_192, 65_536
#: Fingerprints that are led down one tree in one task.
ROUTED = 262_144


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 values of the shingles of the lower-cased text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for a, b in slices(n, 65_536):
        votes += np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


def distances(fps: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int64)


class VantageTree:
    """Nodes (vantage, radius, inner, outer); negative children are leaves ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, reach: int, leaf_sample: int = LEAF_SAMPLE):
        self.reach, self.nodes, self.leaves = reach, [], 0
        self.root = self._grow(np.unique(sample), leaf_sample)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, fps: np.ndarray, leaf_sample: int) -> int:
        if fps.size <= leaf_sample:
            return self._leaf()
        best = None
        for vantage in fps[:: max(1, fps.size // 24)]:
            # Of each candidate the radius with the fewest visits per balanced split.
            count = np.bincount(distances(fps, vantage), minlength=65)
            inner = np.cumsum(count)[:64]
            low = np.r_[np.zeros(self.reach, dtype=np.int64), inner[: 64 - self.reach]]
            high = np.r_[inner[self.reach:], np.full(self.reach, fps.size)]
            small = np.minimum(inner, fps.size - inner)
            score = np.where(small * 5 >= fps.size, (high - low) / np.maximum(small, 1), np.inf)
            r = int(np.argmin(score))
            if best is None or score[r] < best[0]:
                best = (score[r], int(vantage), r)
        if not np.isfinite(best[0]):
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append(None)
        near = distances(fps, best[1]) <= best[2]
        self.nodes[at] = (best[1], best[2], self._grow(fps[near], leaf_sample), self._grow(fps[~near], leaf_sample))
        return at

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own) of every leaf that may hold a partner within reach; ``own`` marks the row's leaf."""
        found = []
        stack = [(self.root, np.arange(fps.size), np.ones(fps.size, dtype=bool))]
        while stack:
            node, rows, own = stack.pop()
            if node < 0:
                found.append((rows, np.full(rows.size, -1 - node), own))
                continue
            vantage, radius, inner, outer = self.nodes[node]
            d = distances(fps[rows], vantage)
            for child, goes, mine in ((inner, d - self.reach <= radius, d <= radius), (outer, d + self.reach > radius, d > radius)):
                if goes.any():
                    stack.append((child, rows[goes], own[goes] & mine[goes]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _places(tree: VantageTree, fps: np.ndarray, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, resident) of the leaves where a fingerprint is compared: its own and later ones of a resident, all within reach of a visitor."""
    rows, leaves, own = tree.visits(fps)
    home = np.full(fps.size, -1, dtype=np.int64)
    mine = own & resident[rows]
    home[rows[mine]] = leaves[mine]
    later = leaves >= home[rows]
    return rows[later], leaves[later], mine[later]


def _first_places(tree):
    """Rows (path, fp, resident) of the leaves of the first tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            if not fps.size:
                continue
            rows, leaves, resident = _places(tree.value, fps, np.ones(fps.size, dtype=bool))
            for a, b in slices(rows.size, 65_536):
                path = pa.array(leaves[a:b]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([path, pa.array(fps[rows[a:b]].view(np.int64)), pa.array(resident[a:b])], ["path", "fp", "resident"])

    return run


def _grown(reach: int, leaf_sample: int):
    """One row (path, tree, leaves): the tree of a leaf from the sample of its residents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = VantageTree(table.column("fp").to_numpy().view(np.uint64), reach, leaf_sample)
        return pa.table({"path": pa.array([key[0].as_py()]), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "leaves": pa.array([tree.leaves], pa.int64())})

    return run


def _led(key: tuple[pa.Scalar, ...], rows: pa.Table, trees: pa.Table) -> pa.Table:
    """Rows of a leaf led down the leaf's own tree."""
    names = ["path", "fp", "resident"]
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.bool_())], names=names)
    tree = pickle.loads(trees.column("tree")[0].as_py())
    fps = rows.column("fp").to_numpy().view(np.uint64)
    at, leaves, resident = _places(tree, fps, rows.column("resident").to_numpy(zero_copy_only=False))
    path = pc.binary_join_element_wise(key[0], pa.array(leaves).cast(pa.string()), "/")
    return pa.table([path, pa.array(fps[at].view(np.int64)), pa.array(resident)], names=names)


def _sizes(places: DataFrame) -> DataFrame:
    return places.groupBy("path").agg(F.count_if("resident").alias("n"), F.count_if(~F.col("resident")).alias("m"))


def fitting_places(fps: DataFrame, max_bits: int, sample: int, leaf_sample: int, block_rows: int) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of frames: places (path, fp, resident) and sizes (path, n residents, m visitors) of the leaves that no tree divides further."""
    spark = fps.sparkSession
    # About ``sample`` of them, chosen by a hash; all of few.
    share = max(1, -(-fps.count() // sample))
    picked = np.sort(fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).toPandas()["fp"].to_numpy(dtype=np.int64))
    tree = spark.sparkContext.broadcast(VantageTree(picked.view(np.uint64), max_bits, leaf_sample))
    places = materialise(fps.mapInArrow(_first_places(tree), "path string, fp long, resident boolean"), "simhash-places")
    done = []
    while True:
        sizes = materialise(_sizes(places), "simhash-sizes")
        large = sizes.where(F.col("n") > block_rows)
        if large.isEmpty():
            return [*done, (places, sizes)]
        share_of = F.ceil(F.col("n") / F.lit(sample))
        sampled = places.where("resident").join(large, "path").where(F.pmod(F.xxhash64("path", "fp"), share_of) == 0)
        grown = sampled.select("path", "fp").groupBy("path").applyInArrow(_grown(max_bits, leaf_sample), "path string, tree binary, leaves long")
        grown = materialise(grown.where("leaves > 1"), "simhash-trees")
        divided = sizes.join(grown.select("path"), "path", "left_semi")
        done.append((places.join(grown.select("path"), "path", "left_anti"), sizes.join(grown.select("path"), "path", "left_anti")))
        parts = divided.select("path", F.ceil((F.col("n") + F.col("m")) / F.lit(ROUTED)).alias("parts"))
        rows = places.join(parts, "path").select("path", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"), "fp", "resident")
        trees = grown.join(parts, "path").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "tree")
        led = rows.groupBy("path", "part").cogroup(trees.groupBy("path", "part")).applyInArrow(_led, "path string, fp long, resident boolean")
        places = materialise(led, "simhash-places")


def dealt(places: DataFrame, sizes: DataFrame, block_rows: int, slice_rows: int) -> DataFrame:
    """Rows (path, block, slice, fp, resident): residents in every slice of their block, visitors and residents of earlier blocks in one."""
    cut = sizes.select(
        "path", F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.when(F.col("n") > block_rows, F.col("n") + F.col("m")).otherwise(F.col("m")) / F.lit(slice_rows))).alias("slices"),
    ).where("blocks > 0")
    first = F.when(F.col("resident"), F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    rows = places.join(cut, "path").withColumn("first", first)
    rows = rows.withColumn("block", F.explode(F.sequence("first", F.col("blocks") - 1)))
    rows = rows.withColumn("resident", F.col("resident") & (F.col("block") == F.col("first")))
    slices_of = F.when(F.col("resident"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("slices"))))
    return rows.select("path", "block", F.explode(slices_of).alias("slice"), "fp", "resident")


def forest(residents: np.ndarray, visitors: np.ndarray, reach: int, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links of residents with visitors and, if ``among``, with each other."""
    fps = np.concatenate([residents, visitors])
    parent = np.arange(fps.size)
    if not residents.size:
        return fps[:0], fps[:0]
    d = distances(fps, int(residents[0]))
    order = np.argsort(d[: residents.size], kind="stable")
    sorted_fps, sorted_d = residents[order], d[: residents.size][order]
    compared = np.arange(0 if among else residents.size, fps.size)
    for dist in np.unique(d[compared]):
        a, b = np.searchsorted(sorted_d, [dist - reach, dist + reach + 1])
        if a == b:
            continue
        rows = compared[d[compared] == dist]
        for lo, hi in slices(rows.size, max(1, (1 << 21) // (b - a))):
            part = rows[lo:hi]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ sorted_fps[a:b][None, :]) <= reach)
            parent = unite(parent, part[i], order[a + j])
    parent = find_roots(parent)
    member = np.flatnonzero(parent != np.arange(fps.size))
    return fps[member], fps[parent[member]]


def _links(reach: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        resident = table.column("resident").to_numpy(zero_copy_only=False)
        a, b = forest(fps[resident], fps[~resident], reach, among=key[2].as_py() == 0)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return run


def link_fingerprints(
    fps: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE, block_rows: int = BLOCK, slice_rows: int = SLICE,
) -> DataFrame:
    """Components of the distinct ``fps(fp)``: rows (node, root) of those that have a link."""
    fitting = fitting_places(fps, max_bits, sample, leaf_sample, block_rows)
    compared = reduce(DataFrame.union, [dealt(places, sizes, block_rows, slice_rows) for places, sizes in fitting])
    edges = compared.groupBy("path", "block", "slice").applyInArrow(_links(max_bits), "a long, b long")
    return components(edges, "simhash")


def _signed(docs: DataFrame, shingle_words: int) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long")


def simhash_near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **tree) -> DataFrame:
    """Rows (doc_id, fp, component_id, root), one for each row of ``docs``.

    component_id is the smallest doc_id reachable, root the smallest fingerprint.
    """
    signed = materialise(_signed(docs, shingle_words), "simhash-fp")
    classes = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-class")
    roots = link_fingerprints(classes.select("fp"), max_bits, **tree)
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id", "root")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_rows(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: the smallest doc_id of each component.

    Of a component whose doc_ids are all null one row stays.
    """
    found = materialise(simhash_near_dedup(docs.select("doc_id", "text"), shingle_words, max_bits), "simhash-found")
    rows = held(docs)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = rows.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    # Rows without an id are told apart by their text.
    nameless = rows.where("doc_id is null").withColumn("sum", F.xxhash64(text_or_empty()))
    roots = found.where("doc_id is null and component_id is null").select("fp", "root").distinct()
    one = _signed(nameless.select(F.col("sum").alias("doc_id"), "text"), shingle_words).join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("one")).select("one")
    first = nameless.join(one, F.col("sum") == F.col("one"), "left_semi").dropDuplicates(["sum"])
    return named.select("row").unionByName(first.select("row")).select("row.*")
