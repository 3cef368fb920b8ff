"""Operator 11: whitening of embeddings by refined eigenvectors of their covariance.

The covariance comes from two passes over the rows (exact integer sums, then
centred products); its float32 eigenvectors are corrected by Ogita-Aishima
iterations, which need nothing but matrix products, in extended precision.
Where eigenvalues lie closer together than the iteration can tell apart, the
cluster's own small problem, shifted by its mean, is solved and rotates its
vectors (sub-solve).

Scale: rows are only mapped. A task sends one sum for each dimension, then
one row of the covariance for each dimension; these are added up by Spark
and only the d x d matrix (d: numbers in a vector, at most MAX_DIMS) reaches
the driver, whatever the number of rows. The whitening matrix, d x 32
numbers, travels with the tasks. No row is shuffled, so equal vectors need
no care.

Defined results: rows whose vector is null, has a null or non-finite entry,
or one beyond +-2^40 go. Vectors of another length than most (of two
frequent lengths, the greater) go too: they have no place in the covariance.
Repeated rows and ids count as often as they occur, a null id stays null.
Components whose eigenvalue is zero within rounding (fewer rows than
dimensions, constant entries) are not returned. ``deviation`` is null where
it does not fit a long. An empty table, or one of equal vectors, gives an
empty result. Further columns of the table are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bound for the matrix on the driver: 4,096 squared doubles are 134 MB.
MAX_DIMS = 4096
#: Entries beyond this are taken as not finite, so that 64 times an entry is exact in a long.
LARGEST = float(2**40)
FACTOR, SHIFT = 64, 1_000_000

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def refined_eigen(a: np.ndarray, max_steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from float32 eigenvectors. Signs: the entry of greatest size is positive.
    """
    d = len(a)
    scale = float(np.abs(a).max()) or 1.0
    high = np.asarray(a, np.longdouble) / np.longdouble(scale)
    high = (high + high.T) / 2
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble)
    norm_a = np.sqrt((high * high).sum())
    eye = np.eye(d, dtype=np.longdouble)
    lam, last = np.diag(high).copy(), np.inf
    for _ in range(max_steps):
        r = eye - x.T @ x
        s = x.T @ (high @ x)
        lam = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(lam)
        limit = 2 * (np.sqrt((off * off).sum()) + norm_a * np.sqrt((r * r).sum()))
        gap = lam[None, :] - lam[:, None]
        apart = np.abs(gap) > limit
        e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-lam, kind="stable")
        x, lam = x[:, order], lam[order]
        moved = float(np.abs(e).max())
        for group in _clusters(lam, limit):
            moved = max(moved, _sub_solve(high, x, lam, group))
        if moved < 1e-18 or (moved < 1e-15 and moved >= last):
            break
        last = moved
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    lam = np.einsum("ij,ij->j", x, high @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-lam, kind="stable")
    x, lam = x[:, order], lam[order]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(d)])
    return lam * scale, x * np.where(sign == 0, 1, sign)


def _clusters(lam: np.ndarray, limit: float) -> list[slice]:
    """Runs of two and more falling eigenvalues, each within ``limit`` of the one before."""
    cuts = np.flatnonzero(lam[:-1] - lam[1:] > limit) + 1
    edges = [0, *cuts.tolist(), len(lam)]
    return [slice(i, j) for i, j in zip(edges, edges[1:]) if j - i > 1]


def _sub_solve(high: np.ndarray, x: np.ndarray, lam: np.ndarray, group: slice) -> float:
    """Solve a cluster's own problem about its mean, and rotate its vectors in place; returns the largest rotation."""
    v = x[:, group]
    v = v + v @ (np.eye(v.shape[1], dtype=v.dtype) - v.T @ v) / 2
    mean = lam[group].mean()
    small = v.T @ (high @ v) - mean * (v.T @ v)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if size == 0:
        x[:, group] = v
        return 0.0
    values, q = np.linalg.eigh((small / size).astype(np.float64))
    q = q[:, ::-1]
    turned = np.abs(np.abs(q).max(0) - 1).max()
    sign = np.sign(q[np.abs(q).argmax(0), np.arange(len(q))])
    x[:, group] = v @ (q * sign).astype(v.dtype)
    lam[group] = mean + size * values[::-1]
    return float(turned) if turned > 1e-15 else 0.0


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has finite entries only."""
    fine = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))
    return vectors.where(F.col(column).isNotNull() & fine)


def _numbers(column, dims: int) -> np.ndarray:
    """The rows of an Arrow list column as longs floor(64 c) + 1000000."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(FACTOR * flat).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each dimension."""
    import pyarrow as pa

    def partials(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _numbers(b.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims), "n": np.full(dims, n), "high": high, "low": low})

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = rows.mapInArrow(partials, "dim long, n long, high long, low long") \
        .groupBy("dim").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("dim").collect()
    return got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got]


class Centre:
    """x - S/n without loss: whole parts as longs, the rest of the mean as a double."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.part = np.array([float(Fraction(s % n, n)) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2; None beyond a long."""
        y = x - self.whole
        rough = ((self.n * y.astype(np.float64) - self.rest) ** 2).sum(1)
        safe = rough < 2.0**62
        t = self.n * np.where(safe[:, None], y, 0) - self.rest * safe[:, None]
        out = (t * t).sum(1).tolist()
        for i in np.flatnonzero(~safe):
            exact = sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(y[i], self.rest)) if rough[i] < 2.0**64 else 2**64
            out[i] = exact if exact < 2**63 else None
        return out


def _covariance(rows: DataFrame, dims: int, n: int, values) -> np.ndarray:
    """The covariance (divisor n) of ``values(batch)``, rows of ``dims`` doubles about a zero mean."""
    import pyarrow as pa

    def partials(batches):
        total, shift = np.zeros((dims, dims)), np.zeros(dims)
        for b in batches:
            y = values(b)
            total += y.T @ y
            shift += y.sum(0)
        out = np.hstack([total, shift[:, None]])
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims), "row": list(out)})

    def added(key, table):
        rows = table["row"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(-1, dims + 1).sum(0)
        return pa.table({"dim": [key[0].as_py()], "row": [total]})

    schema = "dim long, row array<double>"
    got = rows.mapInArrow(partials, schema).groupBy("dim").applyInArrow(added, schema).orderBy("dim").collect()
    full = np.array([r["row"] for r in got])
    mean = full[:, -1] / n
    return full[:, :-1] / n - np.outer(mean, mean)


def whiten(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = 32) -> DataFrame:
    """Whitened coordinates of every usable row, one row a component."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector")), "vector") \
        .where(F.size("vector") > 0)
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dims = lengths["dims"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} numbers: the covariance on the driver is bounded to {MAX_DIMS}")
    rows = rows.where(F.size("vector") == dims)
    n, sums = _sums(rows.select("vector"), dims)
    centre = Centre(n, sums)
    cov = _covariance(rows.select("vector"), dims, n, lambda b: centre.centred(_numbers(b.column(0), dims)))
    values, axes = refined_eigen(cov)
    kept = min(components, int((values > dims * 1e-15 * max(float(values[0]), 0.0)).sum()))
    if not kept:
        return spark.createDataFrame([], RESULT)
    matrix = (axes[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)
    explained = (values[:kept] / np.trace(cov)).astype(np.float64)
    white = _covariance(rows.select("vector"), kept, n, lambda b: centre.centred(_numbers(b.column(0), dims)) @ matrix)
    error = float(np.abs(white - np.eye(kept)).max())
    names = [f.split()[0] for f in RESULT.split(", ")]

    def coordinates(batches):
        for b in batches:
            x = _numbers(b.column(1), dims)
            m = len(x)
            pick = np.repeat(np.arange(m), kept)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(pick)),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                pa.array(np.full(m * kept, n)),
                pa.array(centre.deviation(x), pa.int64()).take(pa.array(pick)),
                pa.array((centre.centred(x) @ matrix).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * kept, error))], names=names)

    return rows.mapInArrow(coordinates, RESULT)
