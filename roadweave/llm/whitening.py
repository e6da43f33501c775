"""Embedding whitening by shifted CholeskyQR (Fukaya et al., 2020): distributed Gram passes orthogonalise the centred rows again and again
through triangular solves; the R factors are composed, and the SVD of R gives the components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, written
from .vectors import finite_rows, matrix, summed

#: An entry c becomes floor(SCALE * c) + OFFSET; products beyond LIMIT stop there.
SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 2.0**62
#: Rows of a slice.
SLICE = 4096


def whole_numbers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + OFFSET)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums, exact: as int64 where that holds it, else as Python integers."""
    if n * max(abs(int(x.min())), abs(int(x.max())), 1) < 2**62 and max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(far: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact."""
    if far.dtype != object and max(-int(far.min()), int(far.max())) ** 2 * far.shape[1] >= 2**63:
        far = far.astype(object)
    return (far * far).sum(axis=1)


def right_solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangle R, by substitution, one column after the other."""
    a, q = np.ascontiguousarray(a.T), np.empty(a.shape[::-1])
    for j in range(len(r)):
        q[j] = (a[j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


@dataclass
class Whitening:
    """n distinct rows with sums; directions: unit components as columns; eigen: their eigenvalues, 0 where the rows don't vary (their
    entries are null when whitened); trace: the sum of all eigenvalues; identity_error: see fit."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigen: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact squared deviations of rows, and their whitened components."""
        far = deviations(x, self.n, self.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (far / self.n).astype(np.float64) @ self.directions / np.sqrt(self.eigen)
        out[:, self.eigen <= 0] = np.nan
        return squares(far), out


def factor(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """R of gram = R'R; shifted adds to the diagonal what rounding may have taken from it."""
    if shifted:
        d = len(gram)
        gram = gram + 11 * (rows * d + d * (d + 1)) * 2.0**-53 * np.linalg.norm(gram, 2) * np.eye(d)
    return np.linalg.cholesky(gram).T


def components(fit_list: DataFrame, n: int, sums: list[int], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as columns) of the centred rows: a shifted pass, then two plain ones."""

    def gram(done: list[np.ndarray]) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            q = (deviations(matrix(batch.column(0), d), n, sums) / n).astype(np.float64)
            for r in done:
                q = right_solve(q, r)
            return (q.T @ q).ravel()

        return summed(fit_list, part, d * d).reshape(d, d)

    first = gram([])
    if not first.any():
        return np.zeros(d), np.eye(d)
    scale = np.abs(np.diag(first)).max()
    factors = [factor(first / scale, n, True) * scale**0.5]
    for last in (False, True):
        g = gram(factors)
        try:
            factors.append(factor(g, n, False))
        except np.linalg.LinAlgError:  # rows of less than full rank
            if not last:
                factors.append(factor(g, n, True))
                continue
            e, u = np.linalg.eigh(g)  # directions without rows get no weight
            factors.append((u * np.sqrt(np.where(e > 1e-6, e, 0.0))) @ u.T)
    whole = factors[0]
    for r in factors[1:]:
        whole = r @ whole
    _, sigma, vt = np.linalg.svd(whole)
    return np.where(sigma > 8 * d * 2.0**-52 * sigma[0], sigma, 0.0), vt.T


def fit(fit_list: DataFrame, d: int, keep: int) -> Whitening | None:
    """Learns from distinct rows x (array of long, all of length d); None if there are none. identity_error is the largest absolute entry of
    the covariance of the whitened rows minus the identity, measured in a pass of its own."""

    def low_and_high(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d)
        return np.concatenate([[len(x)], (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)])

    counted = summed(fit_list, low_and_high, 2 * d + 1, np.int64).tolist()
    n, sums = counted[0], [low + (high << 32) for low, high in zip(counted[1 : d + 1], counted[d + 1 :], strict=True)]
    if not n:
        return None
    sigma, v = components(fit_list, n, sums, d)
    keep = min(keep, d)
    v = v[:, :keep] * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)[:keep]
    eigen = sigma**2 / n
    model = Whitening(n, sums, v, eigen[:keep], float(eigen.sum()))
    use = int((model.eigen > 0).sum())
    if use:

        def moments(batch: pa.RecordBatch) -> np.ndarray:
            w = model.apply(matrix(batch.column(0), d))[1][:, :use]
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        found = summed(fit_list, moments, use + use * use) / n
        mean, second = found[:use], found[use:].reshape(use, use)
        model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(use)).max())
    return model


def whiten(vectors: DataFrame, keep: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal, exact), whitened, explained, identity_error: for each row that
    takes part and each of its first keep components.

    Entries become whole numbers first; each distinct row of them counts once for the fit. Rows with null vectors, or null or non-finite
    entries, take no part, nor do rows of a rarer length (with a warning). Null and repeated ids, and repeated rows, are whitened row by
    row. Of fewer dimensions than keep all are returned. A component along which nothing varies has explained 0 and null in whitened; if
    nothing varies at all, explained is null. A deviation of more than 38 digits is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, _, d = finite_rows(vectors, id_col, vector_col)
    rows = rows.select("vec_id", whole_numbers(F.col("v")).alias("x"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(written(rows.select("x").distinct(), "fit-list"), d, keep) if d else None
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.eigen)
    explained = model.eigen / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            m = batch.num_rows
            deviation, white = model.apply(matrix(batch.column(1), d))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array([x if x < 10**38 else None for x in deviation.tolist()], pa.decimal128(38, 0)).take(each),
                    pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
