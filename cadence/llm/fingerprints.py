"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every byte window is ranked by its rarity, the information content of its byte
pairs under the pair counts of the whole corpus. Of every run of neighbouring
windows the rarest wins a vote, ties by a hash of the window, and windows with
enough votes are the features: which they are depends on the bytes around them
only. Features go into Bloom filters in the order of the text; a filter that
is full opens the next. The likeness of two digests is the mean, over the
filters of the shorter, of the best share of common bits beyond those that
chance makes common.

Defined cases: a null text counts as empty and has the empty digest; two empty
digests are alike (1), an empty and another one are not (0); texts shorter than
a window are one feature; documents are ordered by (doc_id, text), a null
doc_id last, and a lone document is its own successor; repeated rows follow
each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import powers, slices, text_or_empty

#: Bytes of a window, windows of a run, votes of a feature.
WINDOW, RUN, VOTES = 12, 24, 8
#: In texts of fewer bytes runs are shorter; the features of the longer ones are then among theirs.
SHORT, SHORT_RUN, SHORT_VOTES = 400, 6, 2
#: Bits of a filter, bits that a feature sets, features of a full filter.
BITS, HASHES, FULL = 2048, 5, 160
#: Groups of neighbouring documents for each task, and the bytes of text that make another task.
GROUPS, TASK_BYTES = 4, 32 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Pairs of neighbouring bytes (first * 256 + second) of all texts, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for a, b in slices(batch.num_rows, 200):
                raw = [t.encode() for t in batch.column(0).slice(a, b - a).to_pylist() if t]
                pairs = _pairs(np.frombuffer(b"".join(raw), np.uint8))
                across = np.cumsum([len(t) for t in raw])[:-1].astype(np.int64) - 1  # pairs of two texts
                total += np.bincount(pairs, minlength=1 << 16) - np.bincount(pairs[across], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    counts = docs.select(text_or_empty().alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = np.zeros(1 << 16, dtype=np.int64)
    for row in counts.collect():  # at most 65,536
        found[row.pair] = row.n
    return found


def rarity(counts: np.ndarray) -> np.ndarray:
    """Information content in bits of each pair of bytes; every pair counts once more than it occurs."""
    found = counts + 1.0
    return np.log2(found.sum() / found).astype(np.float32)


def _pairs(raw: np.ndarray) -> np.ndarray:
    return (raw[:-1].astype(np.uint16) << np.uint16(8)) | raw[1:]


def _run_max(values: np.ndarray, run: int) -> np.ndarray:
    """Maximum of every ``run`` consecutive values."""
    n = values.size
    size = -(-n // run) * run
    padded = np.zeros(size, dtype=values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, run)
    before = np.maximum.accumulate(table, axis=1).ravel()
    after = np.maximum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(after[: n - run + 1], before[run - 1 : n])


def features(data: bytes, bits: np.ndarray) -> np.ndarray:
    """Numbers of the selected windows, in the order of the text."""
    n = len(data)
    if n <= WINDOW:
        return np.array([xxhash.xxh3_64_intdigest(data)], dtype=np.uint64) if n else np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    sums = np.cumsum(bits[_pairs(raw)], dtype=np.float64)
    # In sixteenths of a bit; rounding makes equal windows rank equal anywhere.
    info = np.rint((sums[WINDOW - 2 :] - np.r_[0.0, sums[: -WINDOW + 1]]) * 16).astype(np.uint64)
    up, down = powers(n)
    rolled = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])
    rolled = (rolled[WINDOW - 1 :] - np.r_[np.uint64(0), rolled[:-WINDOW]]) * down[: n - WINDOW + 1]
    key = (info << np.uint64(48)) | (((rolled ^ (rolled >> np.uint64(29))) * FACTOR) >> np.uint64(16))
    run, least = (SHORT_RUN, SHORT_VOTES) if n < SHORT else (RUN, VOTES)
    best = _run_max(key, min(run, key.size))
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    votes = np.diff(np.r_[first, best.size])
    won = best[first[votes >= min(least, votes.max())]]
    _, once = np.unique(won, return_index=True)
    return won[np.sort(once)]


def filters(numbers: np.ndarray) -> np.ndarray:
    """Packed Bloom filters, one row each."""
    count = -(-numbers.size // FULL)
    table = np.zeros((count, BITS), dtype=np.uint8)
    mixed = (numbers ^ (numbers >> np.uint64(31))) * FACTOR
    mixed ^= mixed >> np.uint64(27)
    row = np.arange(numbers.size) // FULL
    for k in range(HASHES):
        table[row, ((mixed >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(table, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; chains of filters as ``filters`` makes them."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    a64, b64 = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    size_a, size_b = np.bitwise_count(a64).sum(axis=1, dtype=np.int64), np.bitwise_count(b64).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, size in zip(a64, size_a):
        best = 0.0
        for lo, hi in slices(len(b64), 4096):
            common = np.bitwise_count(row & b64[lo:hi]).sum(axis=1, dtype=np.int64)
            chance = size * size_b[lo:hi] / BITS
            best = max(best, float(((common - chance) / np.maximum(np.minimum(size, size_b[lo:hi]) - chance, 1e-9)).max()))
        total += min(1.0, best) * size
    return float(total / size_a.sum())


def digest(text: str, bits: np.ndarray) -> np.ndarray:
    return filters(features(text.encode(), bits))


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _deal(bounds, after, first_of):
    """Rows (grp, guest, doc_id, z): a document in its group, and a group's first one also in the group before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        firsts, befores = first_of.value, after.value
        for batch in batches:
            for a, b in slices(batch.num_rows, 1000):
                part = batch.slice(a, b - a)
                group = group_of(part.column(0), bounds.value)
                packed = [pack.compress(t.encode()) for t in part.column(1).to_pylist()]
                ids = part.column(0).to_pylist()
                extra = [i for i, (g, d) in enumerate(zip(group.tolist(), ids)) if firsts[g] == (d is None, d or 0) and befores[g] != g]
                take = [*range(len(ids)), *extra]
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([int(group[i]) for i in range(len(ids))] + [befores[int(group[i])] for i in extra], pa.int64()),
                    "guest": pa.array([False] * len(ids) + [True] * len(extra)),
                    "doc_id": pa.array([ids[i] for i in take], pa.int64()),
                    "z": pa.array([packed[i] for i in take], pa.binary()),
                })

    return run


def group_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    null = np.asarray(ids.is_null())
    return np.where(null, bounds.size, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right"))


def _text(packed: pa.ChunkedArray, at: int) -> str:
    return zstandard.ZstdDecompressor().decompress(packed[at].as_py()).decode()


def _in_order(guest: list, ids: list, packed: pa.ChunkedArray) -> Iterator[tuple[bool, bool, int, int]]:
    """(guest, null, doc_id, place) in the order of the documents; only texts of repeated ids are unpacked for it."""
    rows = sorted((g, d is None, d or 0, i) for i, (g, d) in enumerate(zip(guest, ids)))
    for _, same in groupby(rows, key=lambda r: r[:3]):
        same = list(same)
        yield from same if len(same) == 1 else sorted(same, key=lambda r: _text(packed, r[3]))


def _compared(bits):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = list(_in_order(table.column("guest").to_pylist(), table.column("doc_id").to_pylist(), table.column("z")))
        own = [r for r in rows if not r[0]]
        following = [*own[1:], *[r for r in rows if r[0]][:1]]
        if len(following) < len(own):
            following.append(own[0])
        out: list[list] = [[] for _ in names]
        text = _text(table.column("z"), own[0][3])
        chain = digest(text, bits.value)
        for (_, null, doc_id, _), (*_, at) in zip(own, following):
            then = _text(table.column("z"), at)
            half = len(text) // 2
            edited = text[: len(text) - half] + then[:half]
            after, changed = digest(then, bits.value), digest(edited, bits.value)
            values = (None if null else doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(chain), as_text(changed), likeness(chain, changed), likeness(chain, after))
            for column, value in zip(out, values):
                column.append(value)
            text, chain = then, after
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def compare_with_next(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the second half replaced by the beginning of the next
    document. Documents are dealt by doc_id into groups of neighbours, their
    number by the bytes of all texts and at least ``GROUPS`` for each shuffle
    partition; a group's first document is also a guest of the group before it.
    Bounds and first ids, one for each group, pass through the driver. A group
    is held compressed, two of its texts at a time beside that; rows of one
    doc_id are in one group.
    """
    spark = docs.sparkSession
    pairs = pair_counts(docs)
    bits = spark.sparkContext.broadcast(rarity(pairs))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(pairs.sum()) // task_bytes))
    groups = GROUPS * tasks
    cuts = docs.stat.approxQuantile("doc_id", [k / groups for k in range(1, groups)], 0.25 / groups)
    bounds = np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)
    shipped = spark.sparkContext.broadcast(bounds)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            for g, d in zip(group_of(batch.column(0), shipped.value).tolist(), batch.column(0).to_pylist()):
                mine = (d is None, d or 0)
                if g not in least or mine < least[g]:
                    least[g] = mine
        yield pa.RecordBatch.from_pydict({
            "grp": pa.array(list(least), pa.int64()),
            "is_null": pa.array([x[0] for x in least.values()], pa.bool_()),
            "least": pa.array([x[1] for x in least.values()], pa.int64()),
        })

    found = docs.select("doc_id").mapInArrow(firsts, "grp long, is_null boolean, least long").groupBy("grp").agg(F.min(F.struct("is_null", "least")).alias("m")).collect()
    used = sorted(r.grp for r in found)
    before = {g: used[i - 1] for i, g in enumerate(used)}
    first_of = {r.grp: (r.m.is_null, r.m.least) for r in found}
    send = spark.sparkContext.broadcast
    dealt = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_deal(shipped, send(before), send(first_of)), "grp long, guest boolean, doc_id long, z binary")
    return dealt.repartition(tasks, "grp").groupBy("grp").applyInArrow(_compared(bits), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
