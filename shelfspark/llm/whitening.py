"""Whitening of embeddings by their leading principal components.

Components become floor(scale * x) long integers. Three passes over the distinct
integer vectors (the fit list) give, per dimension of vector: number and exact
sums; the covariance, every vector centred before it is multiplied; and, as a
check, the covariance of the whitened vectors. Tasks add up their own vectors
and Spark sums the partial matrices by entry, so the driver gets one matrix.

The matrix is reduced to a tridiagonal one by Householder reflections, its
leading eigenvalues are found by bisection on Sturm counts, their vectors by
inverse iteration, orthogonalised again within clusters of close eigenvalues,
and turned back by the reflections. Mean and components are broadcast (at most
dimension x (components + 1) doubles) and every row is projected where it is.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped; an empty vector has no component and gives no row; vectors of
different dimension are fitted apart; entries beyond the range of long integers
take its ends; repeated rows count once in the fit and each give their rows; ids
may be null; components with less than 1e-10 of the variance (fewer distinct
vectors than components, constant entries) are left out; of equal eigenvalues any orthonormal
choice is taken; a deviation of more than 63 bits is null; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import ship_package, stored

SCALE = 256
COMPONENTS = 4
BLOCK_VALUES = 1 << 22  # numbers that a task turns into doubles at once
EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues closer than this part of the norm form a cluster
NEGLIGIBLE = 1e-10  # part of the trace below which an eigenvalue can be rounding
ITERATIONS = 6  # of the inverse iteration

ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


class Whitening(NamedTuple):
    """The fitted projection of vectors of one dimension."""
    n: int
    sums: list[int]          # exact, per entry
    mean: np.ndarray         # sums / n
    components: np.ndarray   # entries x components, unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.eigenvalues)


def integer_vectors(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the floors of the scaled entries, of rows with a whole, finite vector."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(v) > 0))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _blocks(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, whole numbers as a matrix) of a batch, in blocks of bounded size."""
    lists = batch.column(batch.schema.get_field_index(column))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dims = lists.value_lengths().to_numpy(zero_copy_only=False)
    begins = np.cumsum(dims) - dims
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        step = max(1, BLOCK_VALUES // dim)
        for a in range(0, len(rows), step):
            some = rows[a:a + step]
            yield dim, some, values[begins[some][:, None] + np.arange(dim)]


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sums per dimension of vector. Entries are added as high
    and low halves, so that no task's sum leaves 63 bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, rows, x in _blocks(batch):
                halves = np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
                n, total = found.get(dim, (0, 0))
                found[dim] = n + len(rows), total + halves
        for dim, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, "int32"), "i": pa.array(np.arange(dim), "int32"),
                                              "n": pa.array([n] * dim, "int64"), "high": total[0], "low": total[1]})

    wide = "decimal(38,0)"
    parts = fit.mapInArrow(partial, "dim int, i int, n long, high long, low long")
    whole = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    sums: dict[int, dict[int, int]] = {}
    count = {}
    for r in whole.collect():  # one row per entry of a vector
        sums.setdefault(r["dim"], {})[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
        count[r["dim"]] = r["n"]
    return {dim: (count[dim], [s[i] for i in range(dim)]) for dim, s in sums.items()}


def _covariance(fit: DataFrame, n: dict[int, int], centred) -> dict[int, np.ndarray]:
    """Mean of the outer products of ``centred(dim, x)`` per dimension of vector."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _blocks(batch):
                y = centred(dim, x)
                if y is not None:
                    found[dim] = found.get(dim, 0.0) + y.T @ y
        for dim, total in found.items():
            for i in range(len(total)):  # the upper triangle, row by row
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], "int32"), "i": pa.array([i], "int32"), "entries": [total[i, i:]]})

    parts = fit.mapInArrow(partial, "dim int, i int, entries array<double>").select("dim", "i", F.posexplode("entries").alias("j", "c"))
    found: dict[int, list] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("c").alias("c")).collect():  # one row per entry of a matrix
        found.setdefault(r["dim"], []).append((r["i"], r["i"] + r["j"], r["c"]))
    out = {}
    for dim, entries in found.items():
        size = max(i for i, _, _ in entries) + 1
        out[dim] = np.zeros((size, size))
        for i, j, c in entries:
            out[dim][i, j] = out[dim][j, i] = c / n[dim]
    return out


# ---------------------------------------------------------------------------
# Leading eigenpairs of a symmetric matrix
# ---------------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Householder reduction: diagonal, off-diagonal and the unit reflectors
    (the k-th one works on the entries after the k-th)."""
    a, reflectors = a.copy(), []
    n = len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        off[k] = x[0]
        length = math.sqrt(float(x @ x))
        if length == abs(float(x[0])):  # nothing below the off-diagonal
            reflectors.append(None)
            continue
        off[k] = -math.copysign(length, x[0])
        x[0] -= off[k]
        v = x / math.sqrt(float(x @ x))
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - float(p @ v) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative pivots of T - at."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection of its own interval."""
    n = len(diagonal)
    around = np.zeros(n)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    slack = EPS * n * max(float(np.abs(diagonal).max()), float(around.max())) + np.finfo(float).tiny
    low = np.full(k, float((diagonal - around).min()) - slack)
    high = np.full(k, float((diagonal + around).max()) + slack)
    below = n - np.arange(k)  # the j-th largest is the first with so many at or below it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            return low + (high - low) / 2
        enough = sturm_count(diagonal, off, middle) >= below
        high = np.where(open_ & enough, middle, high)
        low = np.where(open_ & ~enough, middle, low)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solver of (T - shift) y = b: elimination with row exchanges, pivots kept off zero."""
    n = len(diagonal)
    main, first, second, factor, swapped = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    a, b = diagonal[0] - shift, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        c, d, e = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(a) >= abs(c):
            a = a if abs(a) >= least else least
            main[i], first[i], factor[i] = a, b, c / a
            a, b = d - factor[i] * b, e
        else:
            swapped[i] = True
            main[i], first[i], second[i], factor[i] = c, d, e, a / c
            a, b = b - factor[i] * d, -factor[i] * e
    main[n - 1] = a if abs(a) >= least else least

    def solve(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            known = (first[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] = (y[i] - known) / main[i]
        return y

    return solve


def _eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of T for falling ``values``, by inverse iteration; within a
    cluster each is kept orthogonal to the ones before it."""
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)))
    random = np.random.default_rng(n)
    found = np.zeros((n, len(values)))
    cluster, shift = 0, math.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        # equal eigenvalues get shifts a few roundings apart, else they'd give one vector
        shift = min(value, shift - 4 * EPS * norm) if j > cluster else value
        solve = _solver(diagonal, off, shift, EPS * norm)
        y = random.standard_normal(n)
        before = found[:, cluster:j]
        for _ in range(ITERATIONS):
            y = solve(y / np.abs(y).max())
            for _ in range(2):
                y -= before @ (before.T @ y)
            y /= math.sqrt(float(y @ y))
        found[:, j] = y
    return found


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``k`` largest eigenvalues that rounding can't have made, and
    their unit vectors as columns (the entry of greatest size positive)."""
    n = len(matrix)
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    scaled = matrix / size
    diagonal, off, reflectors = tridiagonal(scaled)
    values = leading_eigenvalues(diagonal, off, min(k, n))
    values = values[values > NEGLIGIBLE * float(np.trace(scaled))]
    vectors = _eigenvectors(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        if v is not None:
            vectors[i + 1:] -= 2.0 * np.outer(v, v @ vectors[i + 1:])
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * size, vectors * signs


# ---------------------------------------------------------------------------
# Fit and projection
# ---------------------------------------------------------------------------

def fit_whitening(vectors: DataFrame, k: int = COMPONENTS) -> dict[int, Whitening]:
    """The projection for each dimension of the integer vectors ``x``, fitted
    on the distinct ones. Copies fold in each task before the shuffle."""
    spark = vectors.sparkSession
    ship_package(spark)
    fit = stored(vectors.select("x").distinct(), "fit-list")
    sums = _sums(fit)
    counts = {dim: n for dim, (n, _) in sums.items()}
    means = spark.sparkContext.broadcast({dim: np.array([t / n for t in total]) for dim, (n, total) in sums.items()})
    models = {}
    for dim, v in _covariance(fit, counts, lambda dim, x: x - means.value[dim]).items():
        n, total = sums[dim]
        values, parts = leading_eigenpairs(v, k)
        models[dim] = Whitening(n, total, means.value[dim], parts, values, float(np.trace(v)))
    shared = spark.sparkContext.broadcast({dim: m for dim, m in models.items() if len(m.eigenvalues)})
    whitened = _covariance(fit, counts, lambda dim, x: shared.value[dim].project(x) if dim in shared.value else None)
    return {dim: m._replace(identity_error=float(np.abs(whitened[dim] - np.eye(len(whitened[dim]))).max()))
            for dim, m in models.items() if dim in whitened}


def _deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - sums)^2, in long integers or, where those could overflow, in Python's."""
    reach = model.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, model.sums))
    if reach * reach * x.shape[1] < 2**63:
        y = model.n * x - np.array(model.sums, "int64")
        return (y * y).sum(axis=1).tolist()
    y = model.n * x.astype(object) - np.array(model.sums, object)
    return [int(s) if s < 2**63 else None for s in (y * y).sum(axis=1)]


def project(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """One row per vector and component, with the broadcast ``models``."""
    spark = vectors.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for dim, some, x in _blocks(batch):
                model = shared.value.get(dim)
                if model is None:
                    continue
                n, k = len(some), len(model.eigenvalues)
                whitened = model.project(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(np.repeat(some, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), n), "int32"),
                    "n": pa.array(np.full(n * k, model.n), "int64"),
                    "deviation": pa.array(_deviations(model, x), "int64").take(pa.array(np.repeat(np.arange(n), k))),
                    "whitened": whitened.reshape(-1),
                    "explained": np.tile(model.eigenvalues / model.trace, n),
                    "identity_error": np.full(n * k, model.identity_error)})

    return vectors.mapInArrow(rows, ROWS)


def whiten(rows: DataFrame, k: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error
    of every row with a usable vector."""
    vectors = integer_vectors(rows, scale, id_col, vector_col)
    return project(vectors, fit_whitening(vectors, k))
