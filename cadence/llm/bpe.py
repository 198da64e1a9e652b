"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are dealt out as chunks that overlap; every chunk is pre-tokenised
and encoded on its own. The matches of the pattern from some position on
depend on that position only, so from the first boundary that two
neighbouring chunks share in their overlap the left chunk's matches equal the
right one's: there they are stitched. Where an overlap has no common boundary
the next chunk is read on from the left chunk's last true boundary.
Decoding concatenates the bytes of the ids.

Defined cases: a null text counts as empty (no ids); a null doc_id is carried;
repeated rows are encoded separately; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
IDS = "doc_id long, n_tokens long, ids binary"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The rank file at ``path`` with ``pattern``, read once for each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def true_ends(pattern: str, text: str, start: int, stop: int) -> list[int]:
    """Ends of the matches from ``start`` on, up to the first at or after ``stop``.

    Matches that touch the end of ``text`` are left out: more text could
    change them.
    """
    ends = []
    for match in splitter(pattern).finditer(text, start):
        if match.end() >= len(text):
            break
        ends.append(match.end())
        if match.end() >= stop:
            break
    return ends


def _ids(enc, text: str) -> bytes:
    return np.asarray(enc.encode_ordinary(text), dtype="<u4").tobytes()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little is held beside them."""
    for batch in batches:
        for a, b in slices(batch.num_rows, rows):
            yield batch.slice(a, b - a)


def _encode_whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for part in _parts(batches):
            ids = [_ids(enc, text) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return run


def _deal_chunks(chunk: int, overlap: int):
    """Rows (row, doc_id, k, last, body): body is the chunk and its overlap with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, len(text), chunk)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row] * len(starts), pa.int64()),
                    "doc_id": pa.array([doc_id] * len(starts), pa.int64()),
                    "k": pa.array(range(len(starts)), pa.int64()),
                    "last": pa.array([s + chunk >= len(text) for s in starts], pa.bool_()),
                    "body": pa.array([text[s:s + chunk + overlap] for s in starts], pa.string()),
                })
                row += 1

    return run


def encode_chunk(enc, pattern: str, body: str, last: bool, chunk: int, overlap: int) -> tuple[int, bytes, bytes]:
    """(end, ids, head) of a chunk.

    ``ids`` cover the matches from the chunk's start to ``end``, the first
    boundary in the overlap that the next chunk has too (-1: none).
    ``head`` holds pairs (boundary, ids before it) within the first overlap,
    for the stitch with the chunk before.
    """
    own = true_ends(pattern, body, 0, overlap if last else chunk + overlap)
    if last:
        end = len(body)
    else:
        ahead = {chunk, *true_ends(pattern, body, chunk, chunk + overlap)}
        end = next((e for e in own if e >= chunk and e in ahead), -1)
    if end < 0:
        return end, b"", b""
    at, head, ids = 0, [(0, 0)], []
    for stop in own:
        if stop > min(overlap, end):
            break
        ids += enc.encode_ordinary(body[at:stop])
        at = stop
        head.append((at, len(ids)))
    ids += enc.encode_ordinary(body[at:end])
    return end, np.asarray(ids, dtype="<u4").tobytes(), np.asarray(head, dtype="<i8").tobytes()


def _encode_chunks(path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            done = [
                encode_chunk(enc, pattern, body, last, chunk, overlap)
                for body, last in zip(batch.column("body").to_pylist(), batch.column("last").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.binary()), pa.array([x[2] for x in done], pa.binary())],
                ["row", "doc_id", "k", "last", "body", "end", "ids", "head"],
            )

    return run


def stitch(enc, pattern: str, chunks: list[tuple[str, bool, int, bytes, bytes]], chunk: int) -> bytes:
    """Join the chunks (body, last, end, ids, head) of one text at their common boundaries."""
    out, k, start = [], 0, 0  # start: where the text is already encoded up to, within chunk k
    while k < len(chunks):
        body, last, end, ids, head = chunks[k]
        met = dict(np.frombuffer(head, "<i8").reshape(-1, 2).tolist())
        if end >= 0 and start in met:
            out.append(ids[4 * met[start]:])
            k, start = k + 1, end - chunk
            continue
        # No common boundary: encode this chunk and the next ones in one piece,
        # until a boundary is also one of the chunk that follows.
        text, j = body[start:chunk] if not last else body[start:], k + 1
        while j < len(chunks):
            follow = set(np.frombuffer(chunks[j][4], "<i8")[::2].tolist()) if chunks[j][2] >= 0 else set()
            base = len(text)
            stop = next((e for e in true_ends(pattern, text + chunks[j][0], 0, base + len(chunks[j][0])) if e - base in follow), -1)
            if stop >= 0:
                text = (text + chunks[j][0])[:stop]
                start = stop - base
                break
            text += chunks[j][0][:chunk] if not chunks[j][1] else chunks[j][0]
            j += 1
        out.append(_ids(enc, text))
        k = j
    return b"".join(out)


def _stitch_group(path: str, pattern: str, chunk: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        rows = list(zip(group["body"], group["last"], group["end"], group["ids"], group["head"]))
        ids = stitch(encoding(path, pattern), pattern, rows, chunk)
        first = group["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(first) else int(first)], dtype="Int64"), "n_tokens": [len(ids) // 4], "ids": [ids]})

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``path`` is the rank file's place on every worker. Texts of one chunk
    never move; longer ones are dealt out over the cluster by chunk and meet
    again by row.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    whole = rows.where(F.length("text") <= chunk_chars).mapInArrow(_encode_whole(path, pattern), IDS)
    dealt = rows.where(F.length("text") > chunk_chars).mapInArrow(_deal_chunks(chunk_chars, overlap_chars), "row long, doc_id long, k long, last boolean, body string")
    coded = dealt.repartition("row", "k").mapInArrow(
        _encode_chunks(path, pattern, chunk_chars, overlap_chars), "row long, doc_id long, k long, last boolean, body string, end long, ids binary, head binary"
    )
    return whole.unionByName(coded.groupBy("row").applyInPandas(_stitch_group(path, pattern, chunk_chars), IDS))


def decode(coded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary), the bytes of the column ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in _parts(batches):
            made = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, "decoded"])

    kinds = dict(coded.dtypes)
    return coded.select(*keep, *([] if "ids" in keep else ["ids"])).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", decoded binary")
