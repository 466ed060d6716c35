"""Whitening of embeddings: covariance of distinct integer vectors, spectral divide and conquer by polar factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.session import write_and_read

GRID = 256
EPS = np.finfo(float).eps
LONG = (1 << 63) - 1


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Every step maps the singular values, which lie between l and 1, closer to 1, with weights that are
    best for l; six steps do from l = 1e-16. For a symmetric matrix the limit has its eigenvectors and the
    signs of its eigenvalues.
    """
    n, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    least = np.linalg.norm(np.linalg.qr(x)[1].diagonal(), -np.inf)
    low = max(min(least / np.sqrt(n), 1.0), EPS / n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        one = np.sqrt(1 + d)
        p = one + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * one))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.concatenate([np.sqrt(r) * x, eye]))[0]
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        new = (new + new.T) / 2
        low = min(low * (p + q * low * low) / (1 + r * low * low), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= 10 * n * EPS and abs(1 - low) < 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are one.

    The shift is the mean of the eigenvalues, which always lies between them, moved a little where it
    meets an eigenvalue. The projector is (polar factor + 1) / 2; its range comes from a QR
    decomposition of its products with fixed random vectors.
    """
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * np.linalg.norm(a):
        return None
    random = np.random.default_rng(n)
    best = None
    for move in (0.0, 0.01, -0.01, 0.03, -0.03, 0.09, -0.09, 0.2, -0.2):
        u = polar(a - (mean + move * spread / np.sqrt(n)) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(np.trace(projector))
        if not 0 < k < n:
            continue
        q = np.linalg.qr(projector @ random.standard_normal((n, k)), "complete")[0]
        q = np.linalg.qr(projector @ q[:, :k], "complete")[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 4 * n * EPS * np.linalg.norm(a):
            break
    return None if best is None else best[1:]


def spectrum(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    a, n = (a + a.T) / 2, len(a)
    most = n if most is None else min(most, n)
    if most <= 0:
        return np.zeros(0), np.zeros((n, 0))
    parts = _split(a) if n > 1 else None
    if parts is None:
        return a.diagonal()[:most].copy(), np.eye(n)[:, :most]
    above, below = parts
    e1, w1 = spectrum(above.T @ a @ above, most)
    e2, w2 = spectrum(below.T @ a @ below, most - len(e1))
    return np.concatenate([e1, e2]), np.concatenate([above @ w1, below @ w2], 1)


def grid(vector: str) -> Column:
    """A vector's entries as whole numbers of 1 / GRID, rounded down."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * GRID) + F.lit(0).cast("long"))


def finite(vector: str) -> Column:
    """Not null, not empty and without null or non-finite entries."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, (1 << 20) // d)):
            part = batch.slice(start, max(1, (1 << 20) // d))
            yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _sums(d: int):
    """Per task the exact sums of all dimensions, as text since they may leave a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _slices(batches, d):
            small = np.abs(x.astype(float)).max() < 2.0**40
            total = [a + int(b) for a, b in zip(total, x.sum(0) if small else x.astype(object).sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": [str(t) for t in total]})

    return run


def _products(shift: np.ndarray, weights: np.ndarray):
    """Per task the sum of y y' over vectors y = (x - shift) weights, row by row."""
    d, k = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _slices(batches, d):
            y = (x - shift) @ weights
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()), "row": list(total)})

    return run


def _covariance(points: DataFrame, n: int, shift: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The covariance of (x - shift) weights: products add up in tasks, then by Spark entry by entry."""
    k = weights.shape[1]
    sums = points.mapInArrow(_products(shift, weights), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((k, k))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / n
    return out


def fit(rows: DataFrame, vector: str = "embedding", most: int = 4) -> dict:
    """Mean, largest components and eigenvalues of the covariance of the distinct grid vectors of ``rows``.

    Copies count once: equal vectors are combined before they are shuffled. Sums are exact; products
    are of centred vectors. To the driver come a sum per dimension and a product per pair of dimensions, so
    what it holds is set by the length of a vector and not by the rows. The spectrum of that matrix is
    taken apart by polar factors (``spectrum``). Components whose eigenvalue is nothing but rounding are left out.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor those of another
    length than the commonest (of equally common ones the longest).
    """
    d = rows.where(finite(vector)).select(grid(vector).alias("x"))
    length = d.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return {"d": 0, "n": 0, "sums": [], "values": [], "trace": 0.0, "weights": np.zeros((0, 0)), "identity_error": 0.0}
    d, size = d.where(F.size("x") == length["d"]), length["d"]
    points = write_and_read(d.distinct(), "points")
    parts = points.mapInArrow(_sums(size), "i int, n long, total string")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    n, totals = sums[0]["n"], [int(r["total"]) for r in sums]
    shift = np.array([t / n for t in totals])
    covariance = _covariance(points, n, shift, np.eye(size))
    trace = float(np.trace(covariance))
    values, components = spectrum(covariance, most)
    real = values > size * EPS * trace
    values, weights = values[real], components[:, real] / np.sqrt(values[real])
    error = float(np.abs(_covariance(points, n, shift, weights) - np.eye(len(values))).max()) if len(values) else 0.0
    return {"d": size, "n": n, "sums": totals, "values": values.tolist(), "trace": trace, "weights": weights, "identity_error": error}


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact; None where they leave a long."""
    far = n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums))
    if far * far * len(sums) < 2.0**62:
        y = n * x - np.array(sums)
        return (y * y).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v <= LONG else None for v in exact]


def whiten(rows: DataFrame, model: dict, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key of every row that can take part, its ``deviation`` and ``whitened`` on each component of ``model``.

    deviation is the sum over dimensions of (n x - S)^2, null beyond a long. What travels to the tasks is
    a number per dimension and component. Rows that repeat a key, and null keys, are rows of their own; an
    empty table gives none. Other columns are not read.
    """
    d, n, sums, weights = model["d"], model["n"], model["sums"], model["weights"]
    shift = np.array([t / n for t in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, d):
            y = (x - shift) @ weights
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(_deviations(x, n, sums), pa.int64()), held], names=["key", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    points = rows.where(finite(vector)).select(F.col(f"`{key}`").alias("key"), grid(vector).alias("x")).where(F.size("x") == d)
    return points.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)
