"""Whitening of embeddings: a distributed exact scatter, cyclic Jacobi rotations on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Whole numbers of a vector are held between these; beyond 1e9 a component counts as that.
LIMIT = 1 << 40
#: Rows that are multiplied at a time: so few that sums of products of 21 bits are exact in doubles.
ROWS = 1024
#: Dimensions up to which the driver holds the matrix.
MOST_DIMENSIONS = 4096
PLACES = Decimal(10) ** 38


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix.

    Each sweep turns every pair of dimensions once, half of them disjoint pairs at a time in the order of a round-robin
    tournament. An entry has vanished if it is below rounding against its own two diagonal entries, not against the largest, so
    that small eigenvalues are as accurate as large ones. Of each vector the largest entry is positive.
    """
    d = len(matrix)
    a, v = np.array(matrix, dtype=float), np.eye(d)
    seats = list(range(d + d % 2))
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(x, y) for x, y in zip(seats[:half], seats[:half - 1:-1], strict=True) if x < d and y < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, dtype=int).reshape(-1, 2).T
            off = a[p, q]
            live = np.abs(off) > tiny * np.sqrt(np.abs(a[p, p] * a[q, q])) + 1e-300
            if not live.any():
                continue
            turned, p, q, off = True, p[live], q[live], off[live]
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m, by_rows in ((a, True), (a, False), (v, False)):
                x, y = (m[p], m[q]) if by_rows else (m[:, p], m[:, q])
                c_, s_ = (c[:, None], s[:, None]) if by_rows else (c, s)
                new = c_ * x - s_ * y, s_ * x + c_ * y
                if by_rows:
                    m[p], m[q] = new
                else:
                    m[:, p], m[:, q] = new
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    return values[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Vectors of a batch (its last column) as whole numbers, which doubles hold exactly."""
    c = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE) + SHIFT, -LIMIT, LIMIT)


def products(z: np.ndarray) -> np.ndarray:
    """z'z of up to ROWS rows of whole numbers of up to 41 bits, exactly, as Python's integers."""
    low = np.mod(z, 1 << 20)
    high = (z - low) / (1 << 20)
    exact = lambda x, y: (x.T @ y).astype(np.int64).astype(object)
    if not high.any():
        return exact(low, low)
    cross = exact(high, low)
    return (exact(high, high) << 40) + ((cross + cross.T) << 20) + exact(low, low)


def summed(vectors: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], list[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums over all tasks of the entries (row, column, whole number) of a matrix that each task gives.

    They are added up in the shuffle, so that the driver gets one number for each entry, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = entries(batches)
        if got:
            i, j, v = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], names=["i", "j", "v"])

    parts = vectors.mapInArrow(run, "i int, j int, v decimal(38,0)")
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


class Whitening:
    """What was fitted: how many vectors, their sums ``total`` (whole numbers), eigenvalues, components, and the trace of the covariance."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.total, self.values, self.components, self.trace = n, total, values, components, trace
        # Vectors are centred in two exact steps: the rounded mean as a whole number, then what is left of it.
        self.middle = [round_(s, n) for s in total]
        self.rest = [s - n * m for s, m in zip(total, self.middle, strict=True)]

    def matrix(self, k: int) -> np.ndarray:
        """Columns that turn a centred vector into its first k whitened values; zero where a component has no variance."""
        e = self.values[:k]
        # A value below what rounding of the largest leaves is no variance.
        live = e > len(self.total) * np.finfo(float).eps ** 2 * max(float(self.values[0]), 0.0)
        return self.components[:, :k] * np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)


def round_(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of rows that have a vector of finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("vec").isNotNull() & ~F.exists("vec", odd))


def fit(rows: DataFrame) -> Whitening | None:
    """Exact sums and scatter of the vectors, and the eigenvectors of their covariance. None if there is no vector.

    ``rows``: vec_id and vec, all of one length. The scatter is that of whole numbers, centred at the rounded mean before they are
    multiplied, in integers: no order of tasks and no lost executor changes a bit of it.
    """
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).first()
    if size is None or not size["d"]:
        return None
    d, n = size["d"], size["n"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: the driver holds the covariance of up to {MOST_DIMENSIONS}")

    def sums(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, int]]:
        total = np.zeros(d, dtype=object)
        for b in batches:
            x = whole(b, d)
            for a in range(0, len(x), ROWS):
                total += x[a : a + ROWS].sum(axis=0).astype(np.int64).astype(object)
        return [(i, -1, v) for i, v in enumerate(total)]

    got = summed(rows, sums)
    total = [got[i, -1] for i in range(d)]
    middle = np.array([round_(s, n) for s in total], dtype=float)

    def scatter(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, int]]:
        total = np.zeros((d, d), dtype=object)
        for b in batches:
            z = whole(b, d) - middle
            for a in range(0, len(z), ROWS):
                total += products(z[a : a + ROWS])
        return [(i, j, total[i, j]) for i in range(d) for j in range(i, d)]

    got = summed(rows, scatter)
    rest = [s - n * round_(s, n) for s in total]
    covariance = np.empty((d, d))
    for (i, j), q in got.items():
        # The one rounding of each entry.
        covariance[i, j] = covariance[j, i] = (n * q - rest[i] * rest[j]) / (n * n)
    return Whitening(n, total, *jacobi(covariance), float(np.trace(covariance)))


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the most frequent length (the greater of equally frequent ones)."""
    most = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (most["d"] if most else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector and its first k components.

    Components are eigenvectors of the covariance of x = floor(1024 c) + 100000, by falling eigenvalue; ``whitened`` is the centred x on
    one of them over the root of its eigenvalue; ``deviation`` is the squared length of n x - S, exact (null beyond 38 digits);
    ``explained`` a component's share of the trace; ``identity_error`` how far the covariance of all whitened values is from the identity.

    Vectors that are null or hold null or infinite components, and those of another length than most have, go. Rows without an
    id, repeated ids and repeated rows are vectors of their own. A component without variance whitens to 0, which
    ``identity_error`` then shows. Components beyond 1e9 count as that. Other columns, whatever their names, are not read. An empty table, or one of
    empty vectors, gives none. Every pass reads the vectors anew; the matrix that goes to all tasks has dimensions times k numbers.
    """
    rows = of_one_length(finite(vectors, id_col, vector_col))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    w = fit(rows)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n = len(w.total), w.n
    k = min(k, d)
    matrix, middle, rest = w.matrix(k), np.array(w.middle, dtype=float), np.array(w.rest, dtype=float) / n
    whole_rest, explained = w.rest, (w.values[:k] / w.trace if w.trace > 0 else np.zeros(k))

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = (whole(b, d) - middle - rest) @ matrix
            first, second = first + y.sum(axis=0), second + y.T @ y
        out = [(i, -1, first[i]) for i in range(k)] + [(i, j, second[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["i", "j", "v"])

    got = {(r["i"], r["j"]): r["v"] for r in rows.mapInArrow(second_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    means = np.array([got[i, -1] for i in range(k)]) / n
    moments = np.array([[got[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(means, means)
    error = float(np.abs(moments - np.eye(k)).max())

    def deviations(z: np.ndarray) -> list[Decimal | None]:
        widest = n * int(np.abs(z).max(initial=0)) + n
        if d * widest * widest < 1 << 63:
            own = ((z.astype(np.int64) * n - np.array(whole_rest, dtype=np.int64)) ** 2).sum(axis=1)
        else:
            own = ((z.astype(np.int64).astype(object) * n - np.array(whole_rest, dtype=object)) ** 2).sum(axis=1)
        return [Decimal(int(x)) if x < PLACES else None for x in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = whole(b, d) - middle
            for a in range(0, len(z), ROWS):
                part = z[a : a + ROWS]
                ids, size = b.column(0).slice(a, ROWS), len(part)
                each = np.repeat(np.arange(size), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), pa.array(deviations(part), pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(((part - rest) @ matrix).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
