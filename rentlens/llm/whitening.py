"""Whitening of embeddings by spectral divide and conquer over QDWH polar decompositions.

An entry c becomes the whole number x = floor(64 c) + 1000000. Sums and the sums of
products of x less the rounded mean are exact integers, so the covariance V is exact
until its last division. Tasks emit partial sums, Spark adds them up by dimension and
by pair of dimensions, and the driver holds one matrix of dimensions x dimensions.

The polar factor U of V - shift has eigenvalue 1 above the shift and -1 below, so
(U + I) / 2 projects on the invariant subspace above. Bases of both subspaces give two
smaller matrices, which are split in turn down to single eigenvectors. U comes from
dynamically weighted Halley steps by QR decompositions. The projection on the largest
components over the root of their eigenvalues is broadcast to the rows.

Vectors that are null, shorter than the longest, or hold null or non-finite entries are
left out. Entries beyond 2**40 / 64 in size count as that. Components without variance
(fewer distinct vectors than dimensions, constant entries) cannot be whitened and have
no rows; so has a table of equal vectors, or an empty one. Repeated rows and rows of
equal or null id count each for themselves. A deviation that no long can hold is null.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 40
EPS = float(np.finfo(float).eps)
ROWS = 1024


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector has all its entries, and the number of dimensions."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & fine)
    size = rows.agg(F.max(F.size(column))).first()[0] or 0
    return rows.where(F.size(column) == size), size


def whole(column: pa.Array, size: int) -> np.ndarray:
    """x - OFFSET of each vector."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exact: in doubles where no sum can pass 2**53, else in Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    return a.astype(object) @ b.astype(object)


def halves(total: np.ndarray) -> list[pa.Array]:
    """Integers as two longs each, total = high * 2**32 + low."""
    return [pa.array(x.astype(np.int64)) for x in (total // (1 << 32), total % (1 << 32))]


def summer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, object), 0
        for batch in batches:
            x = whole(batch.column("vector"), size)
            total, n = total + product(np.ones((1, len(x)), np.int64), x)[0], n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), *halves(total), pa.array([n] * size, pa.int64())], ["i", "high", "low", "n"])

    return add


def multiplier(size: int, centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products of entries less the centre, by pair of dimensions i <= j."""
    i, j = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size), object), 0
        for batch in batches:
            d = whole(batch.column("vector"), size) - centre
            total, n = total + product(d.T, d), n + len(d)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *halves(total[i, j])], ["i", "j", "high", "low"])

    return add


def exact(column: str) -> F.Column:
    return F.sum(F.col(column).cast("decimal(38,0)")).alias(column)


def moments(rows: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, a whole centre near the mean, sums about it, and the covariance, from exact sums."""
    n, sums = 0, np.zeros(size, object)
    for r in rows.mapInArrow(summer(size), "i int, high long, low long, n long").groupBy("i").agg(exact("high"), exact("low"), F.sum("n").alias("n")).collect():
        n, sums[r.i] = r.n, int(r.high) * (1 << 32) + int(r.low)
    if not n:
        return 0, np.zeros(size, np.int64), sums, np.zeros((size, size))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = sums - n * centre.astype(object)
    covariance = np.zeros((size, size))
    for r in rows.mapInArrow(multiplier(size, centre), "i int, j int, high long, low long").groupBy("i", "j").agg(exact("high"), exact("low")).toLocalIterator():
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * (int(r.high) * (1 << 32) + int(r.low)) - rest[r.i] * rest[r.j]) / n**2
    return n, centre, rest, covariance


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = max(1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1)), EPS / 4)
    except np.linalg.LinAlgError:
        low = EPS / 4
    for _ in range(40):
        d = np.cbrt(4 * max(1 - low**2, 0) / low**4)
        h = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        last, x = x, b / c * x + (h - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        x = (x + x.T) / 2
        low = min(low * (h + b * low**2) / (1 + c * low**2), 1.0)
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - last) < np.cbrt(5 * EPS):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces of the eigenvalues above and below a shift near their mean."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    for step in (0.0, 0.05, -0.05, 0.13, -0.13, 0.29, -0.29, 0.011, -0.011):
        u = polar(a - (mean + step * spread) * np.eye(n))
        above = int(round((n + np.trace(u)) / 2))
        if not 0 < above < n or np.linalg.norm(u @ u - np.eye(n)) > 1e-10 * n:
            continue  # an eigenvalue lies on the shift
        projector = (u + np.eye(n)) / 2
        basis, _ = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, above)))
        basis, _ = np.linalg.qr(projector @ basis)
        full, _ = np.linalg.qr(basis, mode="complete")
        return full[:, :above], full[:, above:]
    return None


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale, n = float(np.linalg.norm(a)), len(a)
    found, waiting = [], [np.eye(n)] if n else []
    while waiting:
        basis = waiting.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        size = len(part)
        if size == 1 or np.linalg.norm(part - np.trace(part) / size * np.eye(size)) <= 4 * EPS * scale:
            found.append(basis)
        elif (bases := split(part)) is not None:
            waiting += [basis @ x for x in bases]
        else:
            raise ArithmeticError("no shift separates the eigenvalues")
    vectors = np.hstack([np.zeros((n, 0)), *found])
    for _ in range(2 if n else 0):  # first-order correction of what rounding left between components
        inner = vectors.T @ a @ vectors
        values = np.diag(inner)
        gaps = values[None, :] - values[:, None]
        wide = np.abs(gaps) > 64 * EPS * scale
        turn = np.where(wide, (inner + inner.T) / 2 / np.where(wide, gaps, 1), 0)
        vectors, r = np.linalg.qr(vectors + vectors @ turn)
        vectors = vectors * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def projected(d: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (d.astype(np.float64) - mean) @ weights


def checker(size: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products of whitened values, by pair of components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, centre, rest, weights, _ = shared.value
        k = weights.shape[1]
        total, seen = np.zeros((k, k)), False
        for batch in batches:
            z = projected(whole(batch.column("vector"), size) - centre, (rest / n).astype(np.float64), weights)
            total, seen = total + z.T @ z, seen or len(z) > 0
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    return add


def whitener(size: int, shared, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, centre, rest, weights, shares = shared.value
        k, square, most = weights.shape[1], int((rest * rest).sum()), (1 << 63) - 1
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                d = whole(part.column("vector"), size) - centre
                own = product(np.ones((1, size), np.int64), (d.astype(object) if np.abs(d).max() > 1 << 24 else d).T ** 2)[0]
                with_rest = product(d, rest.reshape(-1, 1))[:, 0]
                deviations = [int(n * n * a - 2 * n * b + square) for a, b in zip(own, with_rest, strict=True)]
                deviations = pa.array([x if x <= most else None for x in deviations], pa.int64())
                rows = pa.array(np.repeat(np.arange(len(part)), k))
                z = projected(d, (rest / n).astype(np.float64), weights)
                columns = [
                    part.column("id").take(rows), pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()), pa.array(np.full(len(rows), n), pa.int64()),
                    deviations.take(rows), pa.array(z.ravel()), pa.array(np.tile(shares, len(part))), pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whiten


def whitened(vectors: DataFrame, components: int = COMPONENTS, identity: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per vector and component: the whitened coordinate, with what the components explain and how far their covariance is from the identity."""
    spark = vectors.sparkSession
    kind = vectors.schema[identity].dataType.simpleString()
    rows, size = usable(vectors.select(F.col(identity).alias("id"), F.col(column).alias("vector")), "vector")
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, centre, rest, covariance = moments(rows, size)
    values, basis = eigenvectors(covariance)
    k = int((values[:components] > size * EPS * max(values, default=0.0)).sum())
    if not n or not k:
        return spark.createDataFrame([], schema)
    weights = basis[:, :k] / np.sqrt(values[:k])
    shared = spark.sparkContext.broadcast((n, centre, rest, weights, values[:k] / np.trace(covariance)))
    sums = rows.mapInArrow(checker(size, shared), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    error = max(abs(r.total / n - (r.i == r.j)) for r in sums)
    return rows.mapInArrow(whitener(size, shared, error), schema)
