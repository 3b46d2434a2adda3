"""Embedding whitening by a one-sided Jacobi SVD.

Vectors become whole numbers on a grid, x = floor(scale * c) + shift, so that counts and sums are exact.
A blockwise TSQR compresses the centred rows: each task folds its blocks into one triangle R, and the
triangles are folded in groups of FAN until one is left. Plane rotations then orthogonalise R's columns;
the accumulated rotations are the components, the columns' lengths the standard deviations times
sqrt(n). No product of rows with themselves is formed, so small deviations keep their digits.

What a task holds is one block of rows and one triangle; the driver gets one sum and one triangle of
the dimension's size. Nothing of a row is shuffled.

Defined cases: a null vector, an empty one and one with a null or non-finite entry take no part; neither
do vectors of another length than most have (ties: the greater length). An entry outside +-2**42
raises ValueError. Repeated rows count each time and pass through. An empty table and vectors without
spread give a model without components; components whose deviation is zero up to rounding are left out.
Equal deviations stand in the order of their dimensions. A sum of squares beyond 64 bits is null. A column
named like the result is replaced, other columns pass whatever their names; texts in them may have any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, without, written

#: Rows of one QR step, triangles folded in one task, sweeps over all pairs of columns at most.
BLOCK, FAN, SWEEPS = 4096, 32, 60
#: Grid of the vectors: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
TINY = np.finfo(np.float64).eps
FIELDS = "deviation bigint, whitened array<double>"


@dataclass
class Model:
    """n fitted vectors, their sums by dimension, unit components (columns), variances and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.variances / self.trace).tolist() if self.trace > 0 else []


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and holds finite numbers only."""
    whole = F.forall(quoted(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where((F.size(quoted(vector_col)) > 0) & whole)


def grid(vectors: pa.Array) -> np.ndarray:
    """The whole numbers of vectors of one length, a row each."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
    if len(c) and np.abs(c).max() > 2.0**52:
        raise ValueError("a vector entry lies outside +-2**42")
    return (np.floor(c).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def by_length(vectors: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(sizes).tolist():
        yield length, vectors.take(pa.array(np.flatnonzero(sizes == length)))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The rows of ``x`` less the mean: an exact whole number divided once."""
    return (n * x - sums) / n


def fold(triangle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The R of the rows below a triangle."""
    return np.linalg.qr(np.vstack([triangle, rows]), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations V (columns) and lengths of R V's orthogonal columns, longest first.

    Each round of a sweep rotates disjoint pairs of columns at once, by the tournament order in which
    every pair meets once a sweep.
    """
    d = r.shape[1]
    a, v = r.T.copy(), np.eye(d)  # rows here are columns of R and V
    ring = np.arange(d + d % 2)
    for _ in range(SWEEPS if d > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (i < d) & (j < d)
            i, j = i[real], j[real]
            alpha, beta, gamma = np.einsum("ij,ij->i", a[i], a[i]), np.einsum("ij,ij->i", a[j], a[j]), np.einsum("ij,ij->i", a[i], a[j])
            norm = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > TINY * norm
            if turn.any():
                i, j, alpha, beta, gamma, norm = (z[turn] for z in (i, j, alpha, beta, gamma, norm))
                worst = max(worst, float((np.abs(gamma) / norm).max()))
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                for m in (a, v):
                    m[i], m[j] = cos[:, None] * m[i] - sin[:, None] * m[j], sin[:, None] * m[i] + cos[:, None] * m[j]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= d * TINY:
            break
    length = np.sqrt(np.einsum("ij,ij->i", a, a))
    order = np.argsort(-length, kind="stable")
    v = v[order].T
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(d)] < 0, -1.0, 1.0), length[order]


def folded(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from the rows (part, values) of ``parts``, merged FAN at a time in order of part."""
    parts = written(parts, "whitening")
    count = parts.count()

    def step(table: pa.Table) -> pa.Table:
        found = table.sort_by("part")
        values = merge([np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in found.column("values")])
        return pa.table({"part": found.column("part").slice(0, 1), "values": pa.array([values], pa.list_(pa.float64()))})

    while count > 1:
        count = -(-count // FAN)
        parts = parts.groupBy((F.col("part") % count).alias("of")).applyInArrow(step, "part bigint, values array<double>")
    rows = parts.collect()
    return np.array(rows[0]["values"]) if rows else None


def per_task(rows: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """One row (part, values) from each task that saw rows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (values := run(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "values": pa.array([values.ravel()], pa.list_(pa.float64()))})

    return rows.mapInArrow(task, "part bigint, values array<double>")


def fit(rows: DataFrame, *, vector_col: str = "embedding") -> Model:
    """The model of all usable vectors of ``rows``."""
    bounded_batches(rows.sparkSession)
    vectors = usable(rows, vector_col).select(F.col(quoted(vector_col)).cast("array<double>").alias("v"))

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for length, same in by_length(batch.column("v")):
                x = grid(same)
                n, sums = found.get(length, (0, 0))
                found[length] = [n + len(x), sums + x.sum(axis=0)]
        if found:
            yield pa.RecordBatch.from_pydict({"size": pa.array(list(found), pa.int32()), "n": [n for n, _ in found.values()], "sums": pa.array([s for _, s in found.values()], pa.list_(pa.int64()))})

    parts = vectors.mapInArrow(totals, "size int, n bigint, sums array<bigint>").select("size", "n", F.posexplode("sums").alias("at", "sum"))
    sizes = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    most = sizes.where("at = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return Model(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    d, n = most[0]["size"], most[0]["n"]
    sums = np.array([r["sum"] for r in sizes.where(F.col("size") == d).orderBy("at").collect()], np.int64)

    def triangle(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        r = None
        for batch in batches:
            for length, same in by_length(batch.column("v")):
                for at in range(0, len(same) if length == d else 0, BLOCK):
                    r = fold(np.zeros((0, d)) if r is None else r, deviations(grid(same.slice(at, BLOCK)), n, sums))
        return r

    def merge(all_: list[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for one in all_:
            r = fold(r, one.reshape(-1, d))
        return r.ravel()

    r = folded(per_task(vectors, triangle), merge).reshape(-1, d)
    components, length = jacobi(r)
    real = length > max(d, 8) * TINY * max(length[0], 1e-300)
    variances = length * length / n
    return Model(n, sums, components[:, real], variances[real], float(variances.sum()))


def projected(x: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Whitened coordinates of rows on the grid."""
    return deviations(x, model.n, model.sums) @ model.components[:, :k] / np.sqrt(model.variances[:k])


def spreads(x: np.ndarray, model: Model) -> pa.Array:
    """Sum over dimensions of (n x - S) squared, exact; null beyond 64 bits."""
    off = model.n * x - model.sums
    if float(np.square(off.astype(np.float64)).sum(axis=1).max(initial=0)) < 2.0**62:
        return pa.array((off * off).sum(axis=1))
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def whiten(rows: DataFrame, model: Model, *, k: int = 8, vector_col: str = "embedding", into: str = "whitening") -> DataFrame:
    """The usable rows with a struct ``into``: deviation (of all dimensions) and the first k coordinates."""
    bounded_batches(rows.sparkSession)
    rows = usable(without(rows, into, vector_col), vector_col).where(F.size(quoted(vector_col)) == len(model.sums))
    schema = rows.select("*", F.lit(None).cast(f"struct<{FIELDS}>").alias(into)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = grid(batch.column(vector_col))
                found = projected(x, model, k)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
                value = pa.StructArray.from_arrays([spreads(x, model), lists], names=["deviation", "whitened"])
                yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def identity_error(rows: DataFrame, model: Model, *, k: int = 8, vector_col: str = "embedding") -> float:
    """Largest entry of the whitened coordinates' covariance less the identity; counts, means and
    centred products of the tasks are merged, never products of raw coordinates."""
    k = min(k, len(model.variances))
    if not k:
        return 0.0
    vectors = usable(rows, vector_col).where(F.size(quoted(vector_col)) == len(model.sums)).select(F.col(quoted(vector_col)).cast("array<double>").alias("v"))

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, off = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        return np.concatenate([[n], a[1 : k + 1] + off * (b[0] / n), a[k + 1 :] + b[k + 1 :] + np.outer(off, off).ravel() * (a[0] * b[0] / n)])

    def moments(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = projected(grid(batch.column("v").slice(at, BLOCK)), model, k)
                mean = w.mean(axis=0)
                one = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                out = one if out is None else joined(out, one)
        return out

    def merge(all_: list[np.ndarray]) -> np.ndarray:
        out = all_[0]
        for one in all_[1:]:
            out = joined(out, one)
        return out

    total = folded(per_task(vectors, moments), merge)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())
