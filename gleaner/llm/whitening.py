"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi on the factor.

Sums and the centred scatter are exact: components become integers, tasks
multiply centred integers in blocks small enough for doubles to hold every sum,
and Spark adds whole numbers.  The covariance is therefore the same however the
rows are partitioned.  Its factor is as large as the vectors are long, not as
the table, so it is rotated on the driver: rotated column norms give the
eigenvalues, normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LARGEST = 2.0 ** 62  # scaled components beyond it count as it
SWEEPS = 60
LIMB = 60            # a scatter entry travels as two whole numbers, split at this bit


@dataclass(frozen=True)
class Model:
    """Whitening of vectors of one length; ``axes`` has a component per column, by falling eigenvalue."""
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float
    shift: int

    @property
    def middle(self) -> np.ndarray:
        """The whole part of the means."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def remainder(self) -> np.ndarray:
        """What is left of the means, from 0 to 1."""
        return np.array([(s % self.n) / self.n for s in self.sums])


def vectors(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the usable vectors of each length, or of one length.

    Null vectors, empty ones and ones with null or non-finite components are left out.
    """
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    broken = np.r_[0, np.cumsum(~np.isfinite(values))]  # nulls are NaN by now
    good = (sizes > 0) & (broken[begin + sizes] == broken[begin])
    for size in np.unique(sizes[good]) if length is None else [length]:
        rows = np.flatnonzero(good & (sizes == size))
        if len(rows):
            yield rows, values[begin[rows][:, None] + np.arange(size)]


def whole(matrix: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * component) + shift, as long."""
    return np.clip(np.floor(scale * matrix), -LARGEST, LARGEST).astype(np.int64) + shift


def _sums(picked: DataFrame, scale: float, shift: int) -> list[tuple[int, int, int, int]]:
    """(length, place, n, sum) of the components of the most frequent length, ties to the longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for rows, matrix in vectors(b.column("v")):
                x = whole(matrix, scale, shift)
                safe = len(x) * float(np.abs(x.astype(np.float64)).max()) < 2.0 ** 62
                n, before = total.get(x.shape[1], (0, [0] * x.shape[1]))
                now = (x if safe else x.astype(object)).sum(axis=0)
                total[x.shape[1]] = n + len(x), [s + int(t) for s, t in zip(before, now)]
        for size, (n, sums) in total.items():
            yield pa.record_batch([pa.array([size] * size), pa.array(range(size), pa.int64()), pa.array([n] * size, pa.int64()),
                                   pa.array(sums, pa.decimal128(38, 0))], ["size", "place", "n", "s"])

    parts = picked.select("v").mapInArrow(run, "size long, place long, n long, s decimal(38,0)")
    sums = materialize(parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    best = sums.filter("place = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best:
        return []
    return [(r.size_, r.place, r.n, int(r.s)) for r in
            sums.filter(F.col("size") == best[0]["size"]).withColumnRenamed("size", "size_").orderBy("place").collect()]


def _products(d: np.ndarray) -> np.ndarray:
    """The exact d^T d of centred integers, as Python numbers where a long may not hold it."""
    top = int(np.abs(d).max(initial=0))
    if top * top >= 1 << 53:
        wide = d.astype(object)
        return wide.T @ wide
    block = max(1, (1 << 53) // max(1, top * top))
    out = np.zeros((d.shape[1], d.shape[1]), object)
    for at in range(0, len(d), block):
        part = d[at:at + block].astype(np.float64)
        out += (part.T @ part).astype(np.int64)  # every partial sum is a whole number below 2^53
    return out


def _scatter(picked: DataFrame, middle: np.ndarray, scale: float, shift: int) -> list[list[int]]:
    """Sums of products of the components less their ``middle``."""
    size = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for b in batches:
            for _, matrix in vectors(b.column("v"), size):
                total += _products(whole(matrix, scale, shift) - middle)
        entries = [(i, j, total[i, j]) for i in range(size) for j in range(i + 1)]
        low = (1 << LIMB) - 1
        yield pa.record_batch([pa.array([i for i, _, _ in entries], pa.int32()), pa.array([j for _, j, _ in entries], pa.int32()),
                               pa.array([int(x) >> LIMB for _, _, x in entries], pa.decimal128(38, 0)),
                               pa.array([int(x) & low for _, _, x in entries], pa.decimal128(38, 0))], ["i", "j", "high", "low"])

    parts = picked.select("v").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    out = [[0] * size for _ in range(size)]
    for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r.i][r.j] = out[r.j][r.i] = (int(r.high) << LIMB) + int(r.low)
    return out


def cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with L L^T = matrix, a column per pivot; pivots are the largest remaining diagonal entries.

    It ends where these are rounding noise, so L has as many columns as the matrix has rank.
    """
    left = matrix.astype(np.float64).copy()
    noise = len(left) * np.finfo(float).eps * max(left.diagonal().max(initial=0.0), 0.0)
    done = np.zeros(len(left), bool)
    columns = []
    for _ in range(len(left)):
        diagonal = np.where(done, -1.0, left.diagonal())
        p = int(diagonal.argmax())
        if diagonal[p] <= noise:
            break
        column = left[:, p] / np.sqrt(diagonal[p])
        column[done] = 0.0
        left -= np.outer(column, column)
        done[p] = True
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(left), 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs, by the circle method."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        a, b = np.array(ring[:len(ring) // 2]), np.array(ring[len(ring) // 2:][::-1])
        real = (a < n) & (b < n)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components) of factor factor^T: columns are rotated until all are orthogonal."""
    a = factor.copy()
    n = a.shape[1]
    for _ in range(SWEEPS if n > 1 else 0):
        worst = 0.0
        for p, q in _rounds(n):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(off.max()))
            turn = off > np.finfo(float).eps
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2.0 * gamma, 1.0), 0.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1.0 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
        if worst <= n * np.finfo(float).eps:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def fit(rows: DataFrame, vector_col: str = "embedding", scale: float = 1024.0, shift: int = 0) -> Model | None:
    """The whitening of all usable vectors, None if there are none.

    Components become ``floor(scale * c) + shift``.  Vectors of another length
    than most have are not used.
    """
    picked = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    sums = _sums(picked, scale, shift)
    if not sums:
        return None
    n, s = sums[0][2], [r[3] for r in sums]
    scatter = _scatter(picked, np.array([x // n for x in s], np.int64), scale, shift)
    rest = [x % n for x in s]
    size = len(s)
    # n^2 times the covariance is a whole number; the quotient is rounded once
    cov = np.array([[(n * scatter[i][j] - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)])
    eigenvalues, axes = jacobi(cholesky(cov))
    trace = sum(n * scatter[i][i] - rest[i] * rest[i] for i in range(size)) / (n * n)
    return Model(n, tuple(s), axes, eigenvalues, trace, scale, shift)


def transform(rows: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding", components: int | None = None) -> DataFrame:
    """(id, deviation, whitened) per usable row.

    ``whitened`` has the row's centred vector on each component over the root
    of its eigenvalue; there are as many components as the rank has, or as
    asked for.  ``deviation`` is the exact sum of ``(n x - sum)^2`` as
    decimal(38, 0), null where it has more digits.  Without a model there are
    no rows.
    """
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    out = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    picked = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if model is None:
        return picked.limit(0).selectExpr("id", "cast(null as decimal(38,0)) as deviation", "v as whitened")
    size, n, middle, remainder = len(model.sums), model.n, model.middle, model.remainder
    rest = np.array([s % n for s in model.sums], np.int64)
    kept = len(model.eigenvalues) if components is None else min(components, len(model.eigenvalues))
    basis = model.axes[:, :kept] / np.sqrt(model.eigenvalues[:kept])
    scale, shift = model.scale, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, matrix in vectors(b.column("v"), size):
                d = whole(matrix, scale, shift) - middle
                w = (d - remainder) @ basis
                top = n * (int(np.abs(d).max()) + 1)
                far = (d if top * top * size < 1 << 62 else d.astype(object)) * n - rest  # n x - sum, in whole numbers
                squares = [int(s) for s in (far * far).sum(axis=1)]
                yield pa.record_batch([b.column("id").take(pa.array(at)), pa.array([s if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0)),
                                       pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return picked.mapInArrow(run, out)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity, measured on the rows; 0 without rows."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    if not pairs:
        return 0.0
    w = F.col("whitened")
    got = whitened.agg(*[F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((x for x in got if x is not None), default=0.0)


def report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Components are numbered from 1 by falling eigenvalue; ``explained`` is the
    eigenvalue's share of all variance.  ``deviation`` is null where a long
    cannot hold it.  Null vectors and ones with null or non-finite components
    have no rows; repeated rows have theirs each; vectors that do not vary, or
    an empty table, give no rows.  Null ids stay null.
    """
    model = fit(rows, vector_col, scale, shift)
    kept = 0 if model is None else min(components, len(model.eigenvalues))
    mapped = materialize(transform(rows, model, id_col, vector_col, components), "whitened")
    error = identity_error(mapped, kept)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:kept]]) if kept else F.array().cast("array<double>")
    each = mapped.select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(0 if model is None else model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
