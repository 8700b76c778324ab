"""Embedding whitening by QDWH spectral divide and conquer.

Vectors become integers, ``x = floor(scale * c)``; the fit list is each distinct integer vector once, so
copies do not pull the components. Its covariance is split with polar decompositions: for a shift
s, the unitary polar factor U of V - s I is its matrix sign, so (U + I) / 2 projects on the space
of the eigenvalues above s. A basis of that space and of its complement splits V into two smaller matrices,
and so on down to single components. QDWH computes the polar factor with QR and Cholesky
factorisations only, in six or seven steps for any condition number.

On Spark: the distinct vectors are found by a hash aggregate over packed integers (copies meet before
the shuffle, a hot vector is one row per task) and landed once. Two passes over them give the exact sums, then
the covariance of the centred vectors: a task emits its d x d sums, which Spark adds up entry by entry.
The d x d matrix alone reaches the driver; means and components, d numbers each, go out with the last pass over
all rows.

Edge cases: vectors that are null, or hold null or non-finite entries, take no part. Vectors of another
length than most do not live in the same space and take no part either (ties: the longer). Values beyond
64 bits are clamped to them, as Spark's floor does. Fewer dimensions than components give that many. A
component without variance (fewer distinct vectors than dimensions, say) has no scale: ``whitened`` is null; a
deviation beyond 64 bits is null; ``explained`` is null if nothing varies. Tied eigenvalues get
some orthonormal basis of their space, the same for all rows. Repeated rows are returned as often as
they come, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, map_batches

_HIGH = (1 << 63) - 1
_TYPES = ("<i2", "<i4", "<i8")  # widths a packed vector comes in, the smallest that holds it


# -- polar factor and spectral divide and conquer, on a d x d matrix ------------------------

def qdwh(matrix: np.ndarray, tolerance: float = 1e-15, steps: int = 40) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix: dynamically weighted Halley iteration."""
    d = len(matrix)
    eye = np.eye(d)
    scale = np.linalg.norm(matrix, 2)
    if scale == 0:
        return eye
    x = matrix / scale
    low = max(1e-16, np.linalg.svd(x, compute_uv=False)[-1] * 0.9)
    for _ in range(steps):
        if abs(1 - low) <= tolerance:
            break
        square = low * low
        g = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + g)
        a = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * g + 8 * (2 - square) / (square * root)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            new = b / c * x + (a - b / c) / np.sqrt(c) * q[:d] @ q[d:].T
        else:
            w = np.linalg.inv(np.linalg.cholesky(eye + c * x.T @ x))
            new = b / c * x + (a - b / c) * (x @ w.T) @ w
        new = (new + new.T) / 2
        still = np.abs(new - x).max() <= 4 * tolerance
        x, low = new, min(1.0, low * (a + b * square) / (1 + c * square))
        if still:
            break
    return x


def _split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if the matrix is a multiple of
    the identity to working precision."""
    d = len(matrix)
    diagonal = np.diag(matrix)
    mean = diagonal.mean()
    spread = np.linalg.norm(matrix - mean * np.eye(d))
    if spread <= 4 * d * np.finfo(float).eps * max(abs(mean), np.abs(matrix).max()):
        return None
    rng = np.random.default_rng(d)
    best = None
    # the mean lies between the smallest and the largest eigenvalue; the others step off a shift that hits one
    for shift in (np.median(diagonal), mean, mean + 0.11 * spread / np.sqrt(d), mean - 0.13 * spread / np.sqrt(d)):
        sign = qdwh(matrix - shift * np.eye(d))
        projector = (sign + np.eye(d)) / 2
        k = round(np.trace(projector))
        if not 0 < k < d:
            continue
        basis, _ = np.linalg.qr(projector @ rng.standard_normal((d, k)))
        basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(np.hstack([basis, rng.standard_normal((d, d - k))]))
        upper, lower = whole[:, :k], whole[:, k:]
        rest = np.linalg.norm(lower.T @ matrix @ upper)
        if best is None or rest < best[0]:
            best = rest, upper, lower
        if rest <= 8 * d * np.finfo(float).eps * np.linalg.norm(matrix):
            break
    return None if best is None else best[1:]


def spectral_components(matrix: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Only subspaces that hold a wanted component are split further."""
    matrix = (matrix + matrix.T) / 2
    wanted = len(matrix) if wanted is None else min(wanted, len(matrix))
    found: list[np.ndarray] = []
    todo = [np.eye(len(matrix))]  # bases, the one with the largest eigenvalues last
    while todo and sum(b.shape[1] for b in found) < wanted:
        basis = todo.pop()
        small = basis.T @ matrix @ basis
        parts = None if basis.shape[1] == 1 else _split((small + small.T) / 2)
        if parts is None:
            found.append(basis)
        else:
            upper, lower = parts
            todo += [basis @ lower, basis @ upper]
    vectors = np.hstack(found) if found else np.empty((len(matrix), 0))
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[:, order]
    peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] if len(order) else np.ones(0)
    return values[order], vectors * np.where(peak < 0, -1.0, 1.0)


# -- integer vectors ----------------------------------------------------------------------

def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * value)`` as 64-bit integers, clamped."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    x = np.clip(scaled, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)  # the last double below 2^63
    x[scaled >= 2.0 ** 63] = _HIGH
    return x


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a list column one after the other, and the edges of its rows."""
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), edges


def _pack(x: np.ndarray) -> bytes:
    kind = next(t for t in _TYPES if (x == x.astype(t)).all())
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.vstack([_unpack(v) for v in column.to_pylist()])


def distinct_integers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """Each distinct integer vector once: ``x`` (packed), ``dims``, and how many rows have it."""
    good = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(_valid(F.col("v")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, edges = _rows(batch.column(0))
        x = _integers(flat, scale)
        packed = [_pack(x[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(np.diff(edges), pa.int64())], ["x", "dims"])

    return map_batches(good, run, "x binary, dims long").groupBy("x", "dims").agg(
        F.count(F.lit(1)).alias("copies"))


def _sums(fit: DataFrame) -> dict[int, int]:
    """Exact sums per dimension: high and low halves are summed apart, so no part can overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                up, down = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                high, low = (up, down) if high is None else (high + up, low + down)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low)],
                                             ["j", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    rows = fit.mapInArrow(run, "j int, high long, low long").groupBy("j").agg(*wide).collect()  # a row per dimension
    return {r["j"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}


def _covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the fit list, divisor n, of vectors centred before they are multiplied."""
    d = len(mean)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - mean
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1]), pa.array(total[upper])], ["k", "v"])

    out = np.zeros((d, d))
    for r in fit.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # d * d / 2 rows
        i, j = divmod(r["k"], d)
        out[i, j] = out[j, i] = r["v"] / n
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
    most = n * int(max(abs(int(x.min())), abs(int(x.max())), 1)) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most <= _HIGH:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= _HIGH else None for v in exact]


RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4,
           scale: int = 256) -> DataFrame:
    """Per row and component: ``n`` distinct vectors fitted, the row's ``deviation`` from their mean, its ``whitened``
    coordinate, the share of variance the component explains, and how far the whitened covariance is from the
    identity."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(_valid(F.col("v")))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    distinct = land(distinct_integers(vectors, vector, scale), "whitening-fit")
    common = distinct.groupBy("dims").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    d = common[0]["dims"] if common else 0
    fit = distinct.where(F.col("dims") == d)
    n = fit.count()
    if not n or not d:
        return spark.createDataFrame([], schema)
    by_dim = _sums(fit)
    sums = [by_dim[j] for j in range(d)]
    mean = np.array([s / n for s in sums])
    covariance = _covariance(fit, mean, n)
    values, axes = spectral_components(covariance, components)
    trace = float(np.trace(covariance))
    varies = values > 8 * d * np.finfo(float).eps * max(trace, 0.0)
    scales = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - mean) @ axes) * scales

    error = _identity_error(fit, project, [int(c) for c in np.flatnonzero(varies)])
    k = len(values)

    def nulls(v: np.ndarray) -> pa.Array:
        return pa.array(v, mask=np.isnan(v))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, edges = _rows(batch.column(1))
        x = _integers(flat, scale).reshape(-1, d)
        every = np.repeat(np.arange(len(x)), k)
        deviation = pa.array(_deviations(x, n, sums), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
             pa.array(np.full(len(every), n, np.int64)), deviation.take(pa.array(every)), nulls(project(x).ravel()),
             nulls(np.tile(explained, len(x))), pa.array([error] * len(every), pa.float64())],
            ["vec_id", *(c.split()[0] for c in RESULT.split(", "))])

    return map_batches(rows.where(F.size("v") == d), run, schema)


def _identity_error(fit: DataFrame, project, used: list[int]) -> float | None:
    """Largest entry of the whitened covariance, measured on the fit list, minus the identity."""
    if not used:
        return None
    names = [f"w{c}" for c in used]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = project(_matrix(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in used], names)

    white = map_batches(fit, run, ", ".join(f"{c} double" for c in names))
    got = white.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    return max(abs(got[f"{a}_{b}"] - (a == b)) for i, a in enumerate(names) for b in names[i:])
