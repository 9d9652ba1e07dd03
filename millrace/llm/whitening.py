"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become integers. Each dimension is shifted by its minimum, so that the values need few bits,
and every bit of a dimension is packed across rows into 64-bit words: a bit plane. The number of rows
with bit a of dimension i and bit b of dimension j is the popcount of two planes' AND, and cross-products
are these counts weighted by 2^(a+b): exact whatever the number of rows. Tasks add their matrices as
integers, the driver centres them as integers (n * cross-products less the products of the sums) and
only then turns to floating point for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.session import materialise

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0**50
SLICE = 4096
TASK_ROWS_BITS = 34
_LIMB = 60


def finite(v: Column, below: float = float("inf")) -> Column:
    """Whether a vector is there and all its entries are numbers under a bound, never null."""
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < below))
    return F.coalesce(usable, F.lit(False))


def vector_rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each size of vector in an Arrow list column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = column.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)[None, :]]


def bit_planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Planes of a matrix of unsigned numbers, dimension by dimension and low bits first, in words."""
    rows, size = shifted.shape
    padded = np.zeros((size, -(-rows // 64) * 64), dtype=np.uint64)
    padded[:, :rows] = shifted.T
    planes = [
        np.packbits((padded[d] >> np.uint64(b) & np.uint64(1)).astype(bool)).view(np.uint64)
        for d in range(size)
        for b in range(int(bits[d]))
    ]
    return np.stack(planes) if planes else np.empty((0, padded.shape[1] // 64), dtype=np.uint64)


def cross_products(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Upper triangle of the sums of products over the rows, from weighted popcounts; exact.

    The matrix is of int64 where every sum fits, else of Python integers.
    """
    rows, size = shifted.shape
    small = 2 * int(bits.max(initial=0)) + rows.bit_length() < 63
    out = np.zeros((size, size), dtype=np.int64 if small else object)
    planes = bit_planes(shifted, bits)
    owner = np.repeat(np.arange(size), bits)
    first = np.concatenate([[0], np.cumsum(bits)])
    power = np.concatenate([np.arange(b) for b in bits]) if len(planes) else np.empty(0, dtype=np.int64)
    weight = np.array([1 << int(p) for p in power], dtype=out.dtype)
    held = np.flatnonzero(bits)
    for number, plane in enumerate(planes):
        i = owner[number]
        at = first[i]
        counts = np.bitwise_count(planes[at:] & plane).sum(axis=1, dtype=np.int64).astype(out.dtype)
        later = held[held >= i]
        sums = np.add.reduceat(counts * weight[at:], first[later] - at)
        out[i, later] += sums * weight[number]
    return out


@dataclass
class Whitening:
    """Exact moments of one size of vector and the components of its covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def solve(n: int, sums: list[int], lows: list[int], products: list[list[int]], components: int) -> Whitening:
    """Components from exact sums of shifted cross-products (upper triangle)."""
    size = len(sums)
    shifted = [s - n * low for s, low in zip(sums, lows, strict=True)]
    v = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            v[i, j] = v[j, i] = (n * products[i][j] - shifted[i] * shifted[j]) / (n * n)
    trace = sum(n * products[i][i] - shifted[i] ** 2 for i in range(size)) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    values = np.where(values > size * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), values, 0.0)
    return Whitening(n, sums, values, vectors, trace)


def _moments(rows: DataFrame) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """Per size of vector: count, sums, minima and maxima of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in slices(batches, SLICE):
            for _, x in vector_rows(batch.column(0)):
                # Two halves, so that no sum of a slice can leave the 64 bits.
                high, low = (x >> 30).sum(axis=0), (x & ((1 << 30) - 1)).sum(axis=0)
                total = high.astype(object) * (1 << 30) + low
                least, most = x.min(axis=0), x.max(axis=0)
                if x.shape[1] in held:
                    n, s, a, b = held[x.shape[1]]
                    held[x.shape[1]] = [n + len(x), s + total, np.minimum(a, least), np.maximum(b, most)]
                else:
                    held[x.shape[1]] = [len(x), total, least, most]
        for size, (n, total, least, most) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([n] * size, pa.int64()),
                    pa.array([int(t) >> _LIMB for t in total], pa.int64()),
                    pa.array([int(t) & ((1 << _LIMB) - 1) for t in total], pa.int64()),
                    pa.array(least, pa.int64()),
                    pa.array(most, pa.int64()),
                ],
                ["size", "dim", "n", "s_high", "s_low", "least", "most"],
            )

    parts = rows.select("x").mapInArrow(
        run, "size int, dim int, n bigint, s_high bigint, s_low bigint, least bigint, most bigint"
    )
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = parts.groupBy("size", "dim").agg(
        F.sum("n"), wide("s_high"), wide("s_low"), F.min("least"), F.max("most")
    )
    out: dict[int, tuple] = {}
    for size, _, n, high, low, least, most in sorted(found.collect()):
        entry = out.setdefault(size, (n, [], [], []))
        entry[1].append((int(high) << _LIMB) + int(low))
        entry[2].append(least)
        entry[3].append(most)
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """One model per size of vector among ``rows`` (x array<bigint>).

    A task returns one row per pair of dimensions, its cross-products in limbs of 60 bits; what comes
    to the driver is the square of the dimensions, whatever the number of vectors.
    """
    moments = _moments(rows)
    lows = {size: np.array(m[2], dtype=np.int64) for size, m in moments.items()}
    bits = {
        size: np.array([(b - a).bit_length() for a, b in zip(m[2], m[3], strict=True)], dtype=np.int64)
        for size, m in moments.items()
    }

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in slices(batches, SLICE):
            for _, x in vector_rows(batch.column(0)):
                size = x.shape[1]
                part = cross_products((x - lows[size]).astype(np.uint64), bits[size])
                if 2 * int(bits[size].max()) + TASK_ROWS_BITS >= 63:
                    part = part.astype(object)
                held[size] = held[size] + part if size in held else part
        for size, matrix in held.items():
            i, j = np.triu_indices(size)
            numbers = [int(v) for v in matrix[i, j]]
            mask = (1 << _LIMB) - 1
            limbs = [pa.array([v >> (_LIMB * k) & mask for v in numbers], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *limbs],
                ["size", "i", "j", "p0", "p1", "p2"],
            )

    parts = rows.select("x").mapInArrow(run, "size int, i int, j int, p0 bigint, p1 bigint, p2 bigint")
    sums = parts.groupBy("size", "i", "j").agg(
        *(F.sum(F.col(f"p{k}").cast("decimal(20,0)")).alias(f"p{k}") for k in range(3))
    )
    products: dict[int, list[list[int]]] = {s: [[0] * s for _ in range(s)] for s in moments}
    for size, i, j, *limbs in sums.collect():
        products[size][i][j] = sum(int(v) << (_LIMB * k) for k, v in enumerate(limbs))
    return {
        size: solve(m[0], m[1], m[2], products[size], min(components, size)) for size, m in moments.items()
    }


def project(x: np.ndarray, model: Whitening) -> tuple[list[int | None], np.ndarray]:
    """Exact deviation of each row (None if it does not fit a long) and its whitened components."""
    reach = max(int(x.max()), -int(x.min())) * model.n + max(map(abs, model.sums))
    kind = np.int64 if len(model.sums) * reach * reach < 1 << 63 else object
    centred = x.astype(kind) * model.n - np.array(model.sums, dtype=kind)
    deviation = [int(d) if d < 1 << 63 else None for d in (centred * centred).sum(axis=1).tolist()]
    scaled = (centred / model.n).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        white = scaled @ model.vectors / np.sqrt(model.values)
    return deviation, np.where(model.values > 0, white, np.nan)


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error).

    Each remaining row of ``vectors`` gives one row per component, components from 1 by falling
    eigenvalue. Vectors that are null, empty or hold null or non-finite numbers are dropped, as are
    those with an entry of 2^50 or more, whose integer would leave a long. Vectors of different sizes
    are fitted apart (their number is taken to be small: one model per size is shipped to the tasks).
    A component without variance has a null ``whitened`` (all of them for a single row); fewer
    dimensions than components give fewer rows. A ``deviation`` beyond a long is null. Null ids stay
    null, repeated rows count and are returned each; of components with equal eigenvalues any basis is
    taken, the same for all rows. ``identity_error`` is measured on the written whitened values, the
    largest over all sizes. Other columns are left out; no rows give no rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(finite(v, LARGEST) & (F.size(v) > 0))
    rows = rows.select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x")
    )
    models = fit(rows, components)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            for at, x in vector_rows(batch.column(1)):
                deviation, white = project(x, models[x.shape[1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array([x.shape[1]] * len(at), pa.int32()),
                        pa.array(deviation, pa.int64()),
                        pa.array(list(white), pa.list_(pa.float64())),
                    ],
                    ["vec_id", "size", "deviation", "white"],
                )

    white = rows.mapInArrow(run, "vec_id bigint, size int, deviation bigint, white array<double>")
    white = materialise(white, "whitened")
    error = identity_error(white, {s: (m.values > 0).tolist() for s, m in models.items()})
    known = F.create_map(
        *(F.lit(x) for s, m in models.items() for x in (s, [float(e) for e in m.explained]))
    ) if models else F.create_map(F.lit(0), F.array(F.lit(0.0)))
    counts = F.create_map(*(F.lit(x) for s, m in models.items() for x in (s, m.n))) if models else F.create_map(F.lit(0), F.lit(0))
    each = white.select("vec_id", "size", "deviation", F.posexplode("white").alias("place", "value"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        counts[F.col("size")].cast("bigint").alias("n"),
        "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        known[F.col("size")][F.col("place")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(white: DataFrame, real: dict[int, list[bool]]) -> float | None:
    """Largest difference between the covariance of the whitened values and the identity.

    ``real`` tells which components of a size have variance; None without any.
    """
    width = max((len(r) for r in real.values()), default=0)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    if not pairs:
        return None
    w = [F.get("white", F.lit(i)) for i in range(width)]
    means = {r[0]: r[1:] for r in white.groupBy("size").agg(*(F.avg(c) for c in w)).collect()}
    mean = F.create_map(*(F.lit(x) for s, m in means.items() for x in (s, [float(v or 0.0) for v in m])))[F.col("size")]
    products = [F.avg((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in pairs]
    worst = [
        abs(value - (i == j))
        for size, *found in white.groupBy("size").agg(*products).collect()
        for (i, j), value in zip(pairs, found, strict=True)
        if j < len(real[size]) and real[size][i] and real[size][j]
    ]
    return max(worst, default=None)
