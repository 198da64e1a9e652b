"""Substring dedup by difference-cover anchors.

A word is removed when a window of ``window`` consecutive words covers it
whose word sequence also starts in a document with a smaller doc_id.

Windows of 13 words at all positions are far too many to compare, so shorter
anchors are hashed at the positions of a difference cover only: modulo 7 the
differences of {0, 1, 3} meet every residue once, so two equal 13-word runs,
however they lie in their documents, hold equal 7-word anchors that both are
at cover positions. Only windows with an anchor that another document has are
then extended to their full length and compared by a 96-bit hash of all words.

Documents are dealt into blocks. A block sends each of its hashes once, to the
hash's bucket, so a passage that very many documents share is one entry of a
block; the bucket answers each block which of its hashes count. The number of
blocks and buckets follows the bytes of all texts, with at least one task for
each shuffle partition, so they hold about as much of a large table as of a
small one, however frequent a passage is; one document is in one block. The
text is dealt out once: the three readings of the blocks share one exchange.

Defined cases: a null or wordless text has no words; documents shorter than a
window lose nothing; a null doc_id is larger than every other; rows that repeat
a doc_id do not remove each other's words; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_factors, powers, text_or_empty

WINDOW = 13
#: Positions modulo the period at which anchors are hashed; all differences occur.
PERIOD, COVER = 7, (0, 1, 3)
#: Blocks of documents, and buckets of hashes, for each task, and the bytes of text that make another task.
BLOCKS, BUCKETS, TASK_BYTES = 4, 1, 64 << 20
#: Bytes of a block that are read at once.
PART_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max
HASH = np.dtype([("a", "<u8"), ("b", "<u4")])
IS_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
IN_COVER = np.isin(np.arange(PERIOD), COVER)


@lru_cache(maxsize=None)
def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([20_240, seed]).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Multilinear hash of every n consecutive values; the high bits are the good ones."""
    m = max(0, hashes.size - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k, factor in enumerate(_factors(n, seed)):
        out += hashes[k : k + m] * factor
    return out


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the words of bytes that end with white space."""
    inner = ~IS_SPACE[raw]
    turn = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    turn = np.r_[0, turn] if raw.size and inner[0] else turn
    begin, end = turn[::2], turn[1::2]
    up, down = powers(raw.size + 1)
    upto = np.zeros(raw.size + 1, dtype=np.uint64)
    np.cumsum(byte_factors()[raw] * up[: raw.size], out=upto[1:])
    h = (upto[end] - upto[begin]) * down[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return begin, end, h ^ (h >> np.uint64(32))


@dataclass
class Block:
    """The words of a block's documents in one row, with what belongs to which document."""

    ids: np.ndarray  # of documents, ascending
    raw: np.ndarray  # their texts, a space after each
    stops: np.ndarray  # where each ends in raw
    begin: np.ndarray  # of each word, its place in raw
    end: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  # its document
    at: np.ndarray  # its place there
    left: np.ndarray  # and the words from it to the document's end

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        ids = table.column("doc_id").fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        texts = [t.encode("utf-8", "surrogatepass") + b" " for t in table.column("text").take(pa.array(order)).to_pylist()]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        stops = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        found, a = [], 0
        while a < raw.size:  # whole documents, of about a part's bytes
            b = int(stops[min(np.searchsorted(stops, a + PART_BYTES), stops.size - 1)])
            begin, end, h = _words(raw[a:b])
            found.append((begin + a, end + a, h))
            a = b
        begin, end, hashes = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(stops, begin, side="right")
        n = np.bincount(doc, minlength=len(texts))
        at = np.arange(hashes.size) - (np.cumsum(n) - n)[doc]
        return cls(ids[order], raw, stops, begin, end, hashes, doc, at, n[doc] - at)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the anchors at cover positions."""
        n = window - PERIOD + 1
        rolled = _rolled(self.hashes, n, 1) >> np.uint64(16)
        on = np.flatnonzero(IN_COVER[self.at[: rolled.size] % PERIOD] & (self.left[: rolled.size] >= n))
        return on, rolled[on]

    def candidates(self, window: int, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor that another document has."""
        on, value = self.anchors(window)
        if not value.size:
            return np.empty(0, np.int64)
        order, first, _ = _groups(value)
        d = self.ids[self.doc[on[order]]]
        last = np.r_[first[1:], value.size] - 1
        known = _among(value[order][first], shared) | (d[first] < d[last])  # stable order: ids ascend in a group
        hit = np.zeros(self.hashes.size + 1, dtype=np.int64)
        hit[on[order]] = np.repeat(known, last - first + 1)
        upto = np.r_[0, np.cumsum(hit)]
        start = np.flatnonzero(self.left >= window)
        return start[upto[start + PERIOD] > upto[start]]

    def window_hashes(self, window: int, start: np.ndarray) -> np.ndarray:
        out = np.empty(start.size, dtype=HASH)
        out["a"] = _rolled(self.hashes, window, 2)[start]
        out["b"] = _rolled(self.hashes, window, 3)[start] >> np.uint64(32)
        return out

    def kept(self, covered: np.ndarray) -> list[bytes]:
        """The words that are not covered, joined by one space, of each document."""
        # Every kept word with the white space byte after it, as a space.
        change = np.zeros(self.raw.size + 1, dtype=np.int8)
        change[self.begin[~covered]] += 1
        change[self.end[~covered] + 1] -= 1
        mask = np.cumsum(change, dtype=np.int8)[:-1] > 0
        flat = np.where(IS_SPACE[self.raw], np.uint8(32), self.raw)[mask].tobytes()
        cuts = np.r_[0, np.cumsum(mask)[self.stops - 1]].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, group): a stable order of the values, the first place of each, each place's group.

    Hashes of two parts are ordered by the first; a group has both equal.
    """
    main = values["a"] if values.dtype.names else values
    order = np.argsort(main, kind="stable")
    v = values[order]
    new = np.ones(v.size, dtype=bool)
    new[1:] = (v["a"][1:] != v["a"][:-1]) | (v["b"][1:] != v["b"][:-1]) if v.dtype.names else v[1:] != v[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _among(values: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which values are among the told ones."""
    if not told.size:
        return np.zeros(values.size, dtype=bool)
    if not values.dtype.names:
        told = np.sort(told)
        return told[np.minimum(np.searchsorted(told, values), told.size - 1)] == values
    told = told[np.argsort(told["a"])]
    met = told[np.minimum(np.searchsorted(told["a"], values["a"]), told.size - 1)]
    return (met["a"] == values["a"]) & (met["b"] == values["b"])


def _dealt(block: int, bucket: np.ndarray, *columns: np.ndarray) -> dict:
    """One row for each bucket: the columns' bytes of its entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if order.size else np.empty(0, np.int64)
    ends = np.r_[first[1:], order.size]
    sorted_columns = [c[order] for c in columns]
    out = {"bucket": pa.array(bucket[order][first], pa.int64()), "blk": pa.array([block] * first.size, pa.int64())}
    for name, c in zip(("h", "d"), sorted_columns):
        out[name] = pa.array([c[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
    return out


def _answers(blocks: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row (blk, h) for each block among the answers."""
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if blocks.size else np.empty(0, np.int64)
    ends = np.r_[first[1:], blocks.size]
    return pa.table({"blk": pa.array(blocks[first], pa.int64()), "h": pa.array([values[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})


def _pack48(values: np.ndarray) -> np.ndarray:
    """48-bit hashes as three 16-bit parts."""
    return np.ascontiguousarray(values.astype("<u8").view("<u2").reshape(-1, 4)[:, :3])


def _unpack48(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, "<u2").reshape(-1, 3)
    return np.ascontiguousarray(np.c_[parts, np.zeros(len(parts), "<u2")]).view("<u8").ravel()


def _send_anchors(window: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        value = np.unique(Block.of(table).anchors(window)[1])
        return pa.table(_dealt(key[0].as_py(), (value % np.uint64(buckets)).astype(np.int64), _pack48(value)))

    return run


def _shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answer each block its hashes that another block has too."""
    parts = [_unpack48(x) for x in table.column("h").to_pylist()]
    value = np.concatenate(parts)
    order = np.argsort(value, kind="stable")
    value, block = value[order], np.repeat(table.column("blk").to_numpy(), [p.size for p in parts])[order]
    same = value[1:] == value[:-1]
    often = np.r_[False, same] | np.r_[same, False]
    return _answers(block[often], _pack48(value[often]))


def _one(table: pa.Table, kind) -> np.ndarray:
    return np.concatenate([kind(x) for x in table.column("h").to_pylist()] or [kind(b"")])


def _send_windows(window: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "blk": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "d": pa.array([], pa.binary())})
        block = Block.of(table)
        start = block.candidates(window, _one(answers, _unpack48))
        hashes, ids = block.window_hashes(window, start), block.ids[block.doc[start]]
        order, first, _ = _groups(hashes)
        pick = np.sort(order[first])  # the smallest document of each; by document, so that equal ids lie together
        bucket = (hashes["a"][pick] >> np.uint64(20)) % np.uint64(buckets)
        return pa.table(_dealt(key[0].as_py(), bucket.astype(np.int64), hashes[pick], ids[pick]))

    return run


def _repeated_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answer each block its hashes that also start in a document smaller than all its own."""
    parts = [np.frombuffer(x, HASH) for x in table.column("h").to_pylist()]
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("d").to_pylist()])
    hashes = np.concatenate(parts)
    block = np.repeat(table.column("blk").to_numpy(), [p.size for p in parts])
    order, first, group = _groups(hashes)
    least = np.minimum.reduceat(ids[order], first)[group]
    later = order[ids[order] > least]
    return _answers(block[later], hashes[later])


def _cover(window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)
        block = Block.of(table)
        told = _one(answers, lambda x: np.frombuffer(x, HASH))
        # A window counts if its hash is in the answers or a smaller document of this block has it.
        start = np.flatnonzero(block.left >= window)
        hashes, ids = block.window_hashes(window, start), block.ids[block.doc[start]]
        order, first, group = _groups(hashes)
        gone = start[order[_among(hashes[order][first], told)[group] | (ids[order] > ids[order][first][group])]]
        change = np.bincount(gone, minlength=block.hashes.size + 1) - np.bincount(gone + window, minlength=block.hashes.size + 1)
        covered = np.cumsum(change)[: block.hashes.size] > 0
        count = [np.bincount(block.doc[rows], minlength=block.ids.size) for rows in (slice(None), covered)]
        columns = (pa.array(block.ids, mask=block.ids == LAST), *map(pa.array, count), pa.array(block.kept(covered), pa.binary()).cast(pa.string()))
        return pa.table(columns, names=names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text), one for each row of ``docs``."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    # Repeated and null ids spread by their text.
    text = text_or_empty()
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(BLOCKS * parts)).alias("blk"), "doc_id", text.alias("text"))
    blocks = dealt.repartition(parts, "blk").groupBy("blk")
    anchors = blocks.applyInArrow(_send_anchors(window, BUCKETS * parts), "bucket long, blk long, h binary")
    shared = anchors.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_shared_anchors, "blk long, h binary")
    windows = blocks.cogroup(shared.repartition(parts, "blk").groupBy("blk")).applyInArrow(_send_windows(window, BUCKETS * parts), "bucket long, blk long, h binary, d binary")
    repeated = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_repeated_windows, "blk long, h binary")
    return blocks.cogroup(repeated.repartition(parts, "blk").groupBy("blk")).applyInArrow(_cover(window), "doc_id long, n_words long, n_removed long, kept_text string")
