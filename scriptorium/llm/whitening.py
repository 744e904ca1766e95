"""Embedding whitening: a randomised range finder over all centred rows, Rayleigh-Ritz, and full dimension if residuals fail.

Vectors become whole numbers, each different one counts once. A power pass multiplies the covariance with an orthonormal
block: a task adds y (y'Q) of its centred rows y, and only a block of dim x (COMPONENTS + OVER) comes back. The small matrix Q'VQ
gives Ritz values and vectors, and V times them minus them times the values are their residuals, at no further pass. When these
are as small as rounding the vectors hold; when PASSES passes don't get there (a flat spectrum), the block is filled up
to full dimension, where one pass is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .moments import finite, matrix, summed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVER, PASSES = 16, 10, 6
#: A Ritz vector holds when its residual is this part of the distance to the nearest other Ritz value, or less.
CLOSE = 1e-11
#: Entries from here on make a vector count as not finite: scaled, they are no whole number of 64 bits with room.
MOST = 2.0**50


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows of the commonest length whose entries are finite, as whole numbers less SHIFT."""
    good = vectors.filter(finite(F.col("embedding"), MOST))
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = good.filter(F.size("embedding") == (length["d"] if length else -1))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


class Fit:
    """n, sums (exact, of numbers less SHIFT), components (columns), values and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], passes: int):
        self.n, self.sums, self.passes = n, sums, passes
        self.full = False

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers are subtracted first, so that nothing is lost to cancellation."""
        whole, part = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.float64)) - np.array(part, np.float64) / self.n


def fit(distinct: DataFrame, components: int = COMPONENTS, over: int = OVER, passes: int = PASSES, seed: int = 12) -> Fit | None:
    """The leading eigenvectors of the covariance of x (array<long>, all of one length); None without rows."""
    first = distinct.first()
    if first is None:
        return None
    dim = len(first["x"])
    total = distinct.agg(F.count("*"), F.array(*(F.sum(F.get("x", F.lit(k)).cast("decimal(38,0)")) for k in range(dim)))).first()
    out = Fit(total[0], [int(s) for s in total[1]], passes)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dim, min(dim, components + over))))[0]

    def power(q: np.ndarray) -> np.ndarray:
        """V times q, and in a last column the diagonal of V."""

        def part(x: np.ndarray) -> np.ndarray:
            y = out.centred(x)
            return np.c_[y.T @ (y @ q), (y * y).sum(0)]

        return summed(distinct, "x", part, (dim, q.shape[1] + 1)) / out.n

    for step in range(passes + 1):
        if step == passes and q.shape[1] < dim:
            q = np.linalg.qr(np.c_[q, rng.normal(size=(dim, dim - q.shape[1]))])[0]
        out.full = q.shape[1] == dim
        z = power(q)
        z, out.trace = z[:, :-1], float(z[:, -1].sum())
        small = q.T @ z
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        u, k = q @ w, min(components, len(e))
        rest = np.linalg.norm(z @ w - u * e, axis=0)[:k]
        gap = np.array([np.min(np.abs(np.delete(e, i) - e[i])) if len(e) > 1 else 1.0 for i in range(k)])
        if out.full or np.all(rest <= CLOSE * gap):
            break
        q = np.linalg.qr(z)[0]
    u = u[:, :k]
    k = int(np.sum(e[:k] > dim * np.finfo(float).eps * max(out.trace, 0.0)))  # those beyond the rank have no direction
    out.values, out.components = e[:k], u[:, :k] / np.linalg.norm(u[:, :k], axis=0)
    return out


def whitened(out: Fit, x: np.ndarray) -> np.ndarray:
    return out.centred(x) @ out.components / np.sqrt(out.values)


def deviation(out: Fit, x: np.ndarray) -> list[int]:
    """Sum of (n * x - S) ** 2 of each row, exact: in 64 bits where they suffice, else in Python's whole numbers."""
    most = max(abs(s) for s in out.sums) + out.n * int(np.abs(x).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        y = out.n * x - np.array(out.sums, np.int64)
        return (y * y).sum(1).tolist()
    y = out.n * x.astype(object) - np.array(out.sums, object)
    return (y * y).sum(1).tolist()


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact), a row for each row and component.

    Vectors that are null or empty, hold a null or non-finite entry or one of 2**50 or more, or have another length than most
    (ties: the shorter) are dropped; zero vectors stay, and so do null and repeated vec_ids. Equal vectors count once in the fit. There
    are up to 16 components, fewer where the dimension or the rank is less, and no rows where all vectors are equal, or the
    table is empty. deviation is null where it passes 64 bits; deviation_exact, a decimal, is null only beyond 38 digits. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors)
    distinct = stored(rows.groupBy("x").agg(F.lit(1)).select("x"))
    out = fit(distinct)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if out is None or not len(out.values):
        return spark.createDataFrame([], schema)
    k = len(out.values)

    def second(x: np.ndarray) -> np.ndarray:
        w = whitened(out, x)
        return w.T @ w

    error = float(np.abs(summed(distinct, "x", second, (k, k)) / out.n - np.eye(k)).max())

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1), np.int64)
            w, far = whitened(out, x), deviation(out, x)
            long = pa.array([f if f < 1 << 63 else None for f in far], pa.int64())
            exact = pa.array([f if f < 10**38 else None for f in far], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            every = lambda v, kind: pa.array(np.full(len(each), v), kind)
            columns = {
                "vec_id": b.column(0).take(each), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": every(out.n, pa.int64()), "deviation": long.take(each), "whitened": pa.array(w.ravel()),
                "explained": pa.array(np.tile(out.values / out.trace, len(x))), "identity_error": every(error, pa.float64()), "deviation_exact": exact.take(each),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of the embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
