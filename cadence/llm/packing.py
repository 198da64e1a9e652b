"""Packing by order-preserving dynamic programming.

The documents of a partition are one stream of ids in their order. Windows of
it become sequences of at most ``seq_len`` ids. Cuts are chosen at document
ends, at sentence ends and, inside long sentences, at a grid, so that padding
plus cut penalties plus a charge for every sequence is least. A sequence is
padded to ``seq_len``, except when its length is a power of two. The
transition "least cost of a window start within reach" is a monotone queue;
the starts at powers of two are looked up.

The stream is packed in blocks of bounded size; what follows the cheapest late
cut of a block opens the next one, so no partition is held in memory.

Defined cases: a null text counts as empty, a document without ids is its end
id alone; a null doc_id is carried; repeated rows are packed separately; very
long documents are cut like others; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, text_or_empty
from .word_bpe import tokenizer

SEQ_LEN = 4096
END_ID = 2
#: Ids between two cut positions that are considered, beside the ends of documents and sentences.
GRID = 64
#: Costs in ids of padding: a cut at a sentence end, a cut elsewhere, a sequence.
SENTENCE_CUT, OTHER_CUT, SEQUENCE = 4, 64, 48
BLOCK_IDS = 1 << 19
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of possible cuts: document ends, sentence ends, and the starts of grid cells without one."""
    n = len(ids)
    ends = np.flatnonzero(sentence_end[ids]) + 1
    cells = np.setdiff1d(np.arange(1, n // grid + 1), ends // grid) * grid
    at = np.concatenate([doc_ends, ends, cells])
    cost = np.concatenate([np.zeros(len(doc_ends)), np.full(len(ends), SENTENCE_CUT), np.full(len(cells), OTHER_CUT)])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    keep = np.r_[True, at[1:] != at[:-1]] & (at <= n)
    return at[keep].astype(np.int64), cost[keep].astype(np.int64)


def best_cuts(at: list[int], cost: list[int], n: int, seq_len: int, final: bool) -> list[int]:
    """Cheapest sequence ends over a stream of ``n`` ids; not ``final``: up to the cheapest cut of the last window."""
    powers = [1 << k for k in range(seq_len.bit_length() - 1)]
    at, cost = [0, *at], [0, *cost]
    index = {p: i for i, p in enumerate(at)}
    total, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # starts in reach, by rising total + position
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - seq_len:
            queue.popleft()
        i = queue[0]
        least, prior = total[i] + seq_len - here + at[i], i
        for power in powers:
            i = index.get(here - power)
            if i is not None and total[i] < least:
                least, prior = total[i], i
        total[j], back[j] = least + cost[j] + SEQUENCE, prior
        key = total[j] + here
        while queue and total[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    if not final:
        # Every window is charged its padding, so the total per id decides.
        late = [i for i in range(1, len(at)) if at[i] > n - seq_len]
        j = min(late, key=lambda i: (total[i] - total[back[late[0]]], i))
    found = []
    while j:
        found.append(at[j])
        j = back[j]
    return found[::-1]


class _Stream:
    """The ids of a partition that are not packed yet, with their documents."""

    def __init__(self, sentence_end: np.ndarray, seq_len: int, grid: int):
        self.sentence_end, self.seq_len, self.grid = sentence_end, seq_len, grid
        self.parts: list[np.ndarray] = []
        self.docs: list[list] = []  # [doc_id, ids of the document, ids packed, ids here]
        self.held = 0
        self.sequence = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append([doc_id, len(ids), 0, len(ids)])
        self.held += len(ids)

    def pack(self, final: bool) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate(self.parts)
        doc_ends = np.cumsum([d[3] for d in self.docs])
        at, cost = cut_positions(ids, doc_ends, self.sentence_end, self.grid)
        rows, d, begin = [], 0, 0
        for end in best_cuts(at.tolist(), cost.tolist(), self.held, self.seq_len, final):
            offset, a = 0, begin
            while a < end:
                doc = self.docs[d]
                n = min(end - a, doc[3])
                rows.append((doc[0], doc[2], n, ids[a:a + n].tobytes(), doc[1], self.sequence, offset))
                doc[2], doc[3], a, offset = doc[2] + n, doc[3] - n, a + n, offset + n
                d += doc[3] == 0
            self.sequence, begin = self.sequence + 1, end
        self.parts, self.docs, self.held = [ids[begin:].copy()], self.docs[d:], len(ids) - begin
        return rows


def _pack(path: str, seq_len: int, end_id: int, grid: int, block: int):
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        stream = _Stream(coder.sentence_end, seq_len, grid)
        for batch in batches:
            for a, b in slices(batch.num_rows, 2000):
                part = batch.slice(a, b - a)
                for doc_id, ids in zip(part.column(0).to_pylist(), coder(part.column(1).to_pylist())):
                    stream.add(doc_id, np.r_[ids, np.uint32(end_id)].astype("<u4", copy=False))
                    if stream.held >= block:
                        yield batch_of(stream.pack(False))
        rows = stream.pack(True)
        if rows:
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, grid: int = GRID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids little-endian unsigned 32-bit.

    One pass without a shuffle: each input partition is packed in its order.
    """
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_pack(path, seq_len, end_id, grid, block_ids), PIECES)
