"""Whitening of embeddings: principal components with unit variance.

The covariance is summed by the executors from centred vectors, a partial
matrix a task. Its leading eigenvectors come from the classical route for
symmetric matrices, on the driver (dimensions squared, whatever the rows):

1. Householder reflections reduce the matrix to tridiagonal form;
2. the Sturm count (how many eigenvalues lie below a shift) brackets each
   leading eigenvalue, and bisection narrows it to double precision;
3. inverse iteration with that shift gives its eigenvector; the vectors of a
   cluster of close eigenvalues are kept orthogonal to each other;
4. the reflections carry the vectors back.

The components are then broadcast and each task projects its rows.

Entries are made whole numbers first, so sums and deviations are exact: 64-bit
where a bound on every product allows, Python integers beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.session import written as stored

EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class WhiteningConfig:
    """Entry c becomes floor(scale * c) + shift. ``rank_tolerance``: a component
    whose eigenvalue is below this share of the trace has no variance to scale."""

    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    rank_tolerance: float = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What a fit learns: counts and exact sums, then the leading components
    (rows of ``vectors``), their eigenvalues and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# --- symmetric eigenproblem -------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflection vectors) of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        top = np.abs(x).max()
        u = np.zeros(n)
        if top > 0 and np.any(x[1:]):
            x /= top
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            u[k + 1:] = x / np.linalg.norm(x)
            p = a @ u
            w = p - (u @ p) * u
            a -= 2 * (np.outer(u, w) + np.outer(w, u))
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diag: np.ndarray, off2: np.ndarray, shift: np.ndarray, floor: float) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of T - shift."""
    count, q = np.zeros(len(shift), dtype=np.int64), None
    for i in range(len(diag)):
        q = diag[i] - shift - (off2[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < floor, -floor, q)  # a pivot of zero counts as negative
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection."""
    n = len(diag)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    lo, hi = float((diag - reach).min()), float((diag + reach).max())
    size = max(abs(lo), abs(hi), np.finfo(np.float64).tiny)
    floor = max(size * EPS * EPS, np.finfo(np.float64).tiny)
    low, high = np.full(k, lo - size * EPS * n), np.full(k, hi + size * EPS * n)
    wanted = n - 1 - np.arange(k)  # as many eigenvalues lie below the one sought
    for _ in range(200):
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        below = sturm_count(diag, off * off, mid, floor) > wanted
        high, low = np.where(below, mid, high), np.where(below, low, mid)
    return low + (high - low) / 2


def _factored(diag: np.ndarray, off: np.ndarray, shift: float, floor: float):
    """T - shift by elimination with row exchanges: (three upper bands, what was
    done to each pair of rows)."""
    n = len(diag)
    u0, u1, u2 = diag - shift, np.append(off, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        below = (off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0)
        if abs(below[0]) > abs(u0[i]):
            m = u0[i] / below[0]
            u0[i + 1], u1[i + 1] = u1[i] - m * below[1], u2[i] - m * below[2]
            u0[i], u1[i], u2[i] = below
            steps.append((True, m))
        else:
            m = below[0] / u0[i] if u0[i] else 0.0
            u0[i + 1], u1[i + 1] = below[1] - m * u1[i], below[2]
            steps.append((False, m))
    return np.where(np.abs(u0) < floor, np.copysign(floor, u0), u0), u1, u2, steps


def _solved(factors, b: np.ndarray, forward: bool) -> np.ndarray:
    u0, u1, u2, steps = factors
    x = b.copy()
    if forward:
        for i, (swapped, m) in enumerate(steps):
            if swapped:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= m * x[i]
    for i in range(len(x) - 1, -1, -1):
        if i + 1 < len(x):
            x[i] -= u1[i] * x[i + 1]
        if i + 2 < len(x):
            x[i] -= u2[i] * x[i + 2]
        x[i] /= u0[i]
        if abs(x[i]) > 1e100:
            x *= 1e-100
    return x


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (rows) for falling eigenvalues, by inverse iteration;
    each is kept orthogonal to the earlier ones of its cluster."""
    size = max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(np.float64).tiny)
    vectors, first = [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            first = j
        factors = _factored(diag, off, value, EPS * size)
        rng = np.random.default_rng(j)
        x = rng.standard_normal(len(diag))
        for step in range(rounds):
            x = _solved(factors, x, forward=step > 0)
            for _ in range(2):
                for v in vectors[first:]:
                    x -= (v @ x) * v
            length = np.linalg.norm(x)
            x = x / length if length > 0 else rng.standard_normal(len(diag))
        vectors.append(x / np.linalg.norm(x))
    return np.array(vectors).reshape(len(values), len(diag))


def leading_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as rows."""
    k = min(k, len(matrix))
    size = np.abs(matrix).max() if k else 0.0
    if size == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diag, off, reflections = tridiagonal(matrix / size)
    values = leading_values(diag, off, k)
    vectors = leading_vectors(diag, off, values)
    for u in reversed(reflections):
        vectors -= 2 * np.outer(vectors @ u, u)
    return values * size, vectors


# --- rows in tasks ----------------------------------------------------------

def _whole(batch: pa.RecordBatch, cfg: WhiteningConfig) -> np.ndarray:
    """The whole-numbered vectors of a batch (rows x dimensions): int64, or
    Python integers if an entry does not fit."""
    column = batch.column("vector")
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * cfg.scale)
    if n and np.abs(scaled).max() >= 2.0 ** 62:
        whole = np.array([int(v) + cfg.shift for v in scaled], dtype=object)
    else:
        whole = scaled.astype(np.int64) + cfg.shift
    return whole.reshape(n, -1)


def _n_times_less(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    most = max(int(np.abs(x).max()) if x.size else 0, 1)
    if x.dtype == object or n * most >= 2 ** 61 or max(abs(s) for s in sums) >= 2 ** 61:
        return n * x.astype(object) - np.array(sums, dtype=object)
    return n * x - np.array(sums, dtype=np.int64)


def _squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    most = int(np.abs(y).max()) if y.size else 0
    if y.dtype == object or most * most * max(y.shape[1], 1) >= 2 ** 63:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def _column_sums(cfg: WhiteningConfig):
    def run(batches):
        n, total = 0, None
        for batch in batches:
            x = _whole(batch, cfg)
            if len(x):
                total = x.astype(object).sum(axis=0) if x.dtype == object else _exact_sum(x) + (0 if total is None else total)
                n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()),
                 pa.array([str(v) for v in total])], names=["dim", "n", "total"])
    return run


def _exact_sum(x: np.ndarray) -> np.ndarray:
    fits = len(x) * max(int(np.abs(x).max()), 1) < 2 ** 62
    return (x.sum(axis=0) if fits else x.astype(object).sum(axis=0)).astype(object)


def _scatter(cfg: WhiteningConfig, n: int, sums: list[int], project=None):
    """A task's sum of outer products of centred vectors (or of their whitened
    projections), upper triangle, a row of the matrix each."""
    def run(batches):
        total = None
        for batch in batches:
            y = (_n_times_less(_whole(batch, cfg), n, sums) / n).astype(np.float64)
            y = y if project is None else y @ project
            if len(y):
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "total"])
    return run


def _matrix(valid: DataFrame, run, d: int, n: int) -> np.ndarray:
    """The tasks' partial matrices, summed by the executors, over n."""
    rows = valid.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((d, d))
    for r in rows.toLocalIterator():  # dimensions squared
        out[r.i, r.j] = out[r.j, r.i] = r.total / n
    return out


def valid_vectors(table: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vector of doubles) of the rows whose vector can be used: not null or
    empty, no null or non-finite entry, of the most frequent length (of equally
    frequent ones the longest; others are no vectors of this table)."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.select(F.col(ident).alias("id"), v.alias("vector")).where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == F.lit(length.d if length else 0))


def fit_whitening(valid: DataFrame, cfg: WhiteningConfig = WhiteningConfig()) -> Whitening | None:
    """The fit over all rows of ``valid_vectors``; None for an empty table."""
    vectors = valid.select("vector")
    parts = vectors.mapInArrow(_column_sums(cfg), "dim int, n long, total string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")) \
        .orderBy("dim").collect()  # one row per dimension
    if not rows:
        return None
    n, sums = rows[0].n, [int(r.s) for r in rows]
    cov = _matrix(vectors, _scatter(cfg, n, sums), len(sums), n)
    values, components = leading_eigen(cov, cfg.components)
    trace = float(np.trace(cov))
    keep = int((values > cfg.rank_tolerance * trace).sum()) if trace > 0 else 0
    return Whitening(n, sums, values[:keep], components[:keep], trace)


def whiten(table: DataFrame, ident: str = "vec_id", vector: str = "embedding",
           cfg: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """A row per usable vector and component: the id column, component (from 1,
    by falling eigenvalue), n (vectors of the fit), deviation (sum over
    dimensions of (n * x - S) squared, exact, decimal(38,0)), whitened,
    explained (share of the trace), identity_error (largest absolute entry of
    the whitened vectors' covariance minus the identity).

    Needs the columns ``ident`` and ``vector``; others are not read. Vectors
    that ``valid_vectors`` leaves out have no rows. Repeated or null ids are
    rows of their own. A component without variance (all vectors equal, fewer
    vectors than dimensions) has no rows. An empty table gives an empty table.
    """
    valid = stored(valid_vectors(table, ident, vector), "whitening-vectors")
    fit = fit_whitening(valid, cfg)
    kind = valid.schema["id"].dataType.simpleString()
    names = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fit is None or not len(fit.values):
        return table.sparkSession.createDataFrame([], names).withColumnRenamed("id", ident)
    scaled = (fit.vectors / np.sqrt(fit.values)[:, None]).T
    cov = _matrix(valid.select("vector"), _scatter(cfg, fit.n, fit.sums, scaled), len(fit.values), fit.n)
    error = float(np.abs(cov - np.eye(len(cov))).max())
    shared = table.sparkSession.sparkContext.broadcast((fit.n, fit.sums, scaled, fit.values / fit.trace))

    def project(batches):
        n, sums, components, explained = shared.value
        k = len(explained)
        for batch in batches:
            y = _n_times_less(_whole(batch, cfg), n, sums)
            if not len(y):
                continue
            white = (y / n).astype(np.float64) @ components
            at = np.repeat(np.arange(len(y)), k)
            far = pa.array(_squares(y), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                 pa.array(np.full(len(at), n)), far.take(pa.array(at)), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(y))), pa.array(np.full(len(at), error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return valid.mapInArrow(project, names).withColumnRenamed("id", ident)
