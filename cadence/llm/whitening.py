"""Embedding whitening from exact bit-sliced cross-products.

An entry c becomes the integer x = floor(1024 c) + 100000. A block of rows is
shifted by its least value in each dimension and cut into bit planes: one bit
of one dimension over all rows of the block, packed into 64-bit words. The
product sum of two dimensions is the sum over pairs of planes of
2**(a + b) * popcount(plane a AND plane b), undone of the shift in whole
numbers, so that it is exact whatever the block. A dimension of ones gives the
sums and the count by the same product. Tasks add up their blocks and send
dimension**2 / 2 numbers in limbs that Spark adds; the driver holds one matrix
of dimension**2, centres it in whole numbers, n G - S S', and only then goes to
floating point and ``eigh``.

Defined cases: a vector that is null or holds a null or non-finite entry is
dropped; of the others, those of the most frequent length are taken (of equally
frequent ones the longest) and those of other lengths dropped; entries beyond
+-2**52 count as that; a null vec_id is carried and repeated rows are rows of
their own; of constant vectors, components without variance are null and
take no part in the identity error; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

SCALE, SHIFT = 1024.0, 100_000
#: Rows of a block of planes; rows that a task projects at a time.
BLOCK = 8_192
#: Bits of a limb and limbs of a sum, so that sums of limbs over tasks fit a long.
LIMB, LIMBS = 40, 5
#: Components with a smaller share of the largest variance have none.
RANK = 1e-12
LARGEST = float(1 << 52)


@dataclass
class Whitening:
    """n, sums and eigen-pairs of the covariance of x, by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def finite(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) of vectors without null and non-finite entries, as doubles."""
    df = vectors.select("vec_id", F.col(vec).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col("v").isNotNull() & ~bad)


def integers(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of the planes that hold a bit, of whole numbers ``y`` >= 0 with a dimension a row."""
    n = y.shape[1]
    pad = -n % 64
    words, dims, bits = [], [], []
    for b in range(int(y.max()).bit_length() if y.size else 0):
        bit = ((y >> b) & 1).astype(np.uint8)
        some = np.flatnonzero(bit.any(axis=1))
        packed = np.packbits(np.pad(bit[some], ((0, 0), (0, pad))), axis=1)
        words.append(np.ascontiguousarray(packed).view(np.uint64))
        dims.append(some)
        bits.append(np.full(some.size, b))
    if not words:
        return np.zeros((0, 0), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(bits)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums x_j x_k over the rows of ``x`` (rows, dimensions), as Python ints; the last dimension is of ones."""
    least = x.min(axis=0)
    y = np.vstack([(x - least).T, np.ones((1, x.shape[0]), dtype=np.int64)])
    words, dims, bits = planes(y)
    d = y.shape[0]
    top = int(bits.max()) if bits.size else 0
    by_power = np.zeros((2 * top + 1, d, d), dtype=np.int64)
    for i in range(len(words)):
        both = np.bitwise_count(words[i] & words[i:]).sum(axis=1, dtype=np.int64)
        # A pair of planes stands for both orders, a plane with itself for one.
        np.add.at(by_power, (bits[i] + bits[i:], dims[i], dims[i:]), both)
        np.add.at(by_power, (bits[i] + bits[i + 1 :], dims[i + 1 :], dims[i]), both[1:])
    total = np.zeros((d, d), dtype=object)
    for power in range(by_power.shape[0]):
        total += by_power[power].astype(object) * (1 << power)
    shift = np.append(least, 0).astype(object)
    ones = total[:, -1].copy()
    return total + np.outer(shift, ones) + np.outer(ones, shift) + np.outer(shift, shift) * x.shape[0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = None, [], 0

        def add() -> None:
            nonlocal total, held, rows
            made = cross_products(np.concatenate(held))
            total, held, rows = (made if total is None else total + made), [], 0

        for batch in batches:
            x = integers(_matrix(batch.column(0), dim))
            for a, b in slices(len(x), BLOCK):
                held.append(x[a:b])
                rows += b - a
                if rows >= BLOCK:
                    add()
        if held:
            add()
        if total is not None:
            j, k = np.triu_indices(dim + 1)
            sums = total[j, k]
            limbs = [[(int(v) >> (LIMB * i)) & ((1 << LIMB) - 1) if i < LIMBS - 1 else int(v) >> (LIMB * i) for v in sums] for i in range(LIMBS)]
            columns = [pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), *(pa.array(x, pa.int64()) for x in limbs)]
            yield pa.RecordBatch.from_arrays(columns, ["j", "k", *(f"l{i}" for i in range(LIMBS))])

    return run


def fit(vectors: DataFrame, vec: str = "embedding", components: int = 8) -> Whitening | None:
    """The leading components of the covariance of all vectors; None without vectors."""
    clean = finite(vectors, vec)
    common = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or common.dim == 0:
        return None
    dim = common.dim
    parts = clean.where(F.size("v") == dim).select("v").mapInArrow(_sums(dim), "j int, k int, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    # dimension ** 2 / 2 rows, whatever the number of vectors.
    rows = parts.groupBy("j", "k").agg(*(F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS))).collect()
    products = np.zeros((dim + 1, dim + 1), dtype=object)
    for r in rows:
        products[r.j, r.k] = products[r.k, r.j] = sum(r[f"l{i}"] << (LIMB * i) for i in range(LIMBS))
    n, sums = products[dim, dim], products[dim, :dim]
    centred = n * products[:dim, :dim] - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in centred], dtype=float)
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, directions = values[order], directions[:, order]
    # One sign for all: the largest entry of a direction is positive.
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return Whitening(dim, n, [int(s) for s in sums], values, directions, float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x_j - S_j)**2; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    far = max(max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums))
    if len(sums) * far * far < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        d = n * x - np.array(sums, dtype=np.int64)
        return pa.array((d * d).sum(axis=1)).cast(kind)
    d = x.astype(object) * n - np.array(sums, dtype=object)
    exact = (d * d).sum(axis=1)
    return pa.array([int(v) if v < 10**38 else None for v in exact], kind)


def transform(vectors: DataFrame, model: Whitening, vec: str = "embedding") -> DataFrame:
    """Rows (vec_id, deviation decimal, whitened array), one for each vector of the fit."""
    dim, n, sums = model.dim, model.n, model.sums
    mean = np.array([s / n for s in sums])
    some = model.values > RANK * max(model.values[0], 0.0)
    scale = model.vectors / np.sqrt(np.where(some, model.values, 1.0))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.num_rows, BLOCK):
                part = batch.slice(a, b - a)
                x = integers(_matrix(part.column(1), dim))
                w = (x - mean) @ scale
                flat = pa.array(w.ravel(), mask=np.tile(~some, b - a))
                made = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), deviations(x, n, sums), made], ["vec_id", "deviation", "whitened"])

    rows = finite(vectors, vec).where(F.size("v") == dim)
    return rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, of components with variance."""
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    row = whitened.agg(*(F.covar_pop(F.get("whitened", F.lit(a)), F.get("whitened", F.lit(b))).alias(f"c{a}_{b}") for a, b in pairs)).first()
    off = [abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs if row[f"c{a}_{b}"] is not None]
    return max(off, default=None)


def whiten(vectors: DataFrame, vec: str = "embedding", components: int = 8) -> DataFrame:
    """Rows (vec_id, n, deviation, whitened, explained, identity_error), one for each remaining vector.

    ``whitened`` and ``explained`` hold a value for each component.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    model = fit(vectors, vec, components)
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        )
    rows = materialise(transform(vectors, model, vec), "whitened")
    error = identity_error(rows, len(model.values))
    explained = F.array(*(F.lit(v) for v in model.explained()))
    return rows.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
