"""Whitening of embeddings by contour-integral eigensolves (FEAST).

Sums and the centred covariance are added up on the executors; only dims x dims numbers come
to the driver. Inertia counts of the shifted covariance (Sturm counts of its tridiagonal form)
say how many eigenvalues lie above any bound, and cut the wanted part of the spectrum into
intervals at wide gaps. Each interval is a task: Gauss-Legendre quadrature of complex shifted
solves on a circle through its ends projects a block of vectors onto the interval's eigenvectors,
Rayleigh-Ritz takes values and vectors from the block, and this is done again until residuals are
at rounding level and as many values lie inside as the inertia counts say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

EPS = float(np.finfo(float).eps)


# ---- eigenvalue counts and intervals ------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, by Householder steps."""
    a = np.array(v, float)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diag: np.ndarray, off: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Eigenvalues over each bound: positive pivots of the LDL' factors of the shifted matrix."""
    tiny = max(EPS * EPS, EPS * EPS * float(np.max(off * off, initial=0.0)))
    pivot = diag[0] - bounds
    n = (pivot > 0).astype(int)
    for d, e in zip(diag[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - bounds - e * e / pivot
        n += pivot > 0
    return n


def eigenvalue_bounds(diag: np.ndarray, off: np.ndarray, k: int, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(below, above) around each of the k largest eigenvalues, by bisection on inertia counts."""
    reach = np.concatenate(([0], np.abs(off))) + np.concatenate((np.abs(off), [0]))
    lo, hi = np.full(k, float((diag - reach).min())), np.full(k, float((diag + reach).max()))
    pad = EPS * len(diag) * max(abs(lo[0]), abs(hi[0]), 1e-300)
    lo, hi = lo - pad, hi + pad
    rank = np.arange(1, k + 1)
    for _ in range(steps):
        at = (lo + hi) / 2
        over = count_above(diag, off, at) >= rank
        lo, hi = np.where(over, at, lo), np.where(over, hi, at)
    return lo, hi


def intervals(diag: np.ndarray, off: np.ndarray, k: int, per: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down until k or more are covered; about `per` in each.

    Ends lie in the middle of the widest gap near every per-th eigenvalue; equal eigenvalues are never parted.
    """
    d = len(diag)
    lo, hi = eigenvalue_bounds(diag, off, d)
    values = (lo + hi) / 2
    spread = max(abs(values[0]), abs(values[-1]), 1e-300)
    gaps = np.append(values[:-1] - values[1:], spread)  # behind the last, as wide as need be
    out, at, high = [], 0, float(hi[0]) + 0.05 * max(float(hi[0] - lo[-1]), EPS * spread * d) + EPS * spread * d
    while at < min(k, d):
        ends = np.arange(at + max(1, per // 2), min(d, at + per + per // 2) + 1) if at + max(1, per // 2) <= d else np.array([d])
        end = int(ends[np.argmax(gaps[ends - 1])])
        while end < d and gaps[end - 1] <= 64 * EPS * spread:
            end += 1
        low = float(values[end - 1] - gaps[end - 1] / 2) if end < d else float(lo[-1] - 0.05 * max(high - lo[-1], EPS * spread * d))
        inside = int(count_above(diag, off, np.array([low]))[0] - count_above(diag, off, np.array([high]))[0])
        out.append((float(low), float(high), inside))
        at, high = at + inside, low
    return out


# ---- one interval ---------------------------------------------------------------------------


def feast(v: np.ndarray, low: float, high: float, inside: int, points: int = 8, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The `inside` eigenpairs between low and high, values falling; an error if they are not all found."""
    d = len(v)
    size = min(d, inside + max(4, inside // 2))
    scale = max(float(np.abs(v).sum(axis=1).max()), 1e-300)
    x, w = np.polynomial.legendre.leggauss(points)
    turn = np.exp(1j * np.pi * (x + 1) / 2)
    middle, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(d).standard_normal((d, size))
    best = None
    for _ in range(rounds):
        kept = np.zeros((d, block.shape[1]))
        for z, weight in zip(turn, w):
            kept += radius / 2 * weight * (z * np.linalg.solve((middle + radius * z) * np.eye(d) - v, block)).real
        q, s, _ = np.linalg.svd(kept, full_matrices=False)
        q = q[:, s > s[0] * EPS * d]
        values, turned = np.linalg.eigh(q.T @ v @ q)
        block = q @ turned
        found = np.flatnonzero((values > low) & (values <= high))
        if len(found) >= inside:
            # values between far eigenvalues may fall inside by chance: theirs are the large residuals
            errs = np.linalg.norm(v @ block[:, found] - block[:, found] * values[found], axis=0)
            near = np.sort(np.argsort(errs, kind="stable")[:inside])
            found, err = found[near], float(errs[near].max(initial=0.0))
            if best is not None and err >= best[0] / 2 and best[0] <= 1e-10 * scale:
                break  # no longer falls: rounding level
            if best is None or err < best[0]:
                best = (err, values[found][::-1], block[:, found][:, ::-1])
            if err <= EPS * scale:
                break
        if block.shape[1] < size:
            block = np.hstack((block, np.random.default_rng(size).standard_normal((d, size - block.shape[1]))))
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError(f"{inside} eigenvalues lie in ({low}, {high}] but were not all found")
    return best[1], best[2]


def components(spark: SparkSession, v: np.ndarray, k: int = 32, per: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the k largest; fewer where the matrix has lower rank."""
    d = len(v)
    if d == 0 or not np.any(v):
        return np.zeros(0), np.zeros((d, 0))
    diag, off = tridiagonal(v)
    least = 4 * d * EPS * float(np.abs(v).sum(axis=1).max())
    k = min(k, int(count_above(diag, off, np.array([least]))[0]))
    wanted = intervals(diag, off, k, per)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, low, high, inside in pdf.itertuples(index=False):
                e, u = feast(v, low, high, int(inside))
                yield pd.DataFrame({"part": i, "e": e, "u": [c.tolist() for c in u.T]})

    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(wanted)], "part int, low double, high double, inside int")
    got = rows.repartition(len(wanted)).mapInPandas(run, "part int, e double, u array<double>").collect()
    if len(got) != sum(x[2] for x in wanted) or len(got) < k:
        raise ArithmeticError("eigenvalues are missing")
    u = np.array([r.u for r in got]).T
    q, _ = np.linalg.qr(u[:, np.argsort([-r.e for r in got], kind="stable")])
    e, turned = np.linalg.eigh(q.T @ v @ q)  # one more Rayleigh-Ritz step, over all intervals together
    order = np.argsort(-e, kind="stable")[:k]
    u = q @ turned[:, order]
    return e[order], u / np.linalg.norm(u, axis=0)


# ---- rows ----------------------------------------------------------------------------------


def integer_rows(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x of every row whose vector is not null and has no null or non-finite entry."""
    e, inf = F.col("embedding"), F.lit(float("inf"))
    whole = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift)).alias("x"))


def _matrix(lists: pa.ListArray, dims: int, fill: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones go on with `fill`."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    if np.all(sizes == dims):
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), fill, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _parts(batches, column: int, dims: int, fill: int, rows: int = 4096):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, _matrix(part.column(column), dims, fill)


def scaled_deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they suffice, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most * 2 < 1 << 62 and max(map(abs, total), default=0) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Row sums of squares, exact; null where a long cannot hold one."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [s if (s := sum(int(y) ** 2 for y in row)) < 1 << 63 else None for row in d]


def sums(rows: DataFrame, dims: int, fill: int) -> list[int]:
    """Exact sums per dimension."""

    def run(batches):
        s = np.zeros(dims, object)
        for _, x in _parts(batches, 0, dims, fill):
            s += x.sum(axis=0) if int(np.abs(x).max(initial=0)) < 1 << 50 else x.astype(object).sum(axis=0)
        high = [int(v) >> 31 for v in s]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high, pa.int64()), pa.array([int(v) - (h << 31) for v, h in zip(s, high)], pa.int64())], ["i", "high", "low"])

    got = {r.i: (int(r.high) << 31) + int(r.low) for r in rows.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()}
    return [got.get(i, 0) for i in range(dims)]


def second_moments(parts: DataFrame, size: int, values) -> np.ndarray:
    """Sum over rows of y y', with a leading one in y (so row 0 holds plain sums); values(batches) gives blocks of rows y."""

    def run(batches):
        m = np.zeros((size + 1, size + 1))
        for y in values(batches):
            y = np.hstack((np.ones((len(y), 1)), y))
            m += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["i", "m"])

    got = dict(parts.mapInArrow(run, "i int, m double").groupBy("i").agg(F.sum("m")).collect())
    return np.array([got.get(i, 0.0) for i in range((size + 1) ** 2)]).reshape(size + 1, size + 1)


def centred(m: np.ndarray, n: int) -> np.ndarray:
    """Covariance, divisor n, from the moments of rows that are centred but for rounding."""
    mean = m[0, 1:] / n
    c = m[1:, 1:] / n - np.outer(mean, mean)
    return (c + c.T) / 2


def whiten(vectors: DataFrame, k: int = 32, scale: int = 64, shift: int = 1_000_000, most_dims: int = 4096) -> DataFrame:
    """A row for each kept vector and each of its first k components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries take no part. All others are rows of their
    own, repeated ones and those without vec_id too, so none and ties are as good as any; a shorter vector goes on with zeros.
    Components are those with an eigenvalue over rounding level, so fewer than k come where vectors lie in a smaller
    space, and none (no rows) where all are equal or the table is empty. Of equal eigenvalues any basis may come, the same
    for all rows. deviation is exact, null where a long cannot hold it. Other columns are not read.
    The driver holds dims x dims numbers; more than most_dims dimensions are refused.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stash(integer_rows(vectors, scale, shift), "whole")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if dims > most_dims:
        raise ValueError(f"{dims} dimensions, more than {most_dims}")
    if n == 0 or dims == 0:
        return spark.createDataFrame([], schema)
    total = sums(rows, dims, shift)

    def deviations(batches, column):
        for part, x in _parts(batches, column, dims, shift):
            yield part, scaled_deviations(x, n, total)

    v = centred(second_moments(rows.select("x"), dims, lambda batches: (d.astype(float) / n for _, d in deviations(batches, 0))), n)
    e, u = components(spark, v, k)
    c = len(e)
    if c == 0:
        return spark.createDataFrame([], schema)
    to = u / np.sqrt(e)
    w = centred(second_moments(rows.select("x"), c, lambda batches: ((d.astype(float) / n) @ to for _, d in deviations(batches, 0))), n)
    explained, identity_error = e / np.trace(v), float(np.abs(w - np.eye(c)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d in deviations(batches, 1):
            r = len(d)
            each = pa.array(np.repeat(np.arange(r), c))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), r)), pa.array(np.full(r * c, n, np.int64)), pa.array(squares(d), pa.int64()).take(each),
                    pa.array(((d.astype(float) / n) @ to).ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * c, identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
