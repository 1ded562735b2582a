"""Covariances and Gram matrices as Spark sums; only p x p numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.operators import quantiles

#: Starts of the robust covariance, and the rows that they are made on.
STARTS, START_ROWS = 100, 2000


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch: one array column, or double columns; null counts as 0."""
    if pa.types.is_list(batch.column(0).type):
        x = [np.asarray(v, float) for v in batch.column(0).to_pylist() if v is not None]
        return np.stack(x) if x else np.zeros((0, 0))
    return np.column_stack([batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, g = 0, None, None
    for batch in batches:
        x = _matrix(batch)
        if len(x):
            n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
    if n:
        p = len(s)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(p * p + p + 1), pa.int32()), "v": pa.array(np.concatenate([g.ravel(), s, [n]]))})


def gram(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, column sums, n) of double columns or of one array column."""
    rows = df.mapInArrow(_sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # p * p + p + 1 numbers
    if not rows:
        return np.zeros((0, 0)), np.zeros(0), 0
    v = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    p = round((-1 + (1 + 4 * (len(v) - 1)) ** 0.5) / 2)
    return v[: p * p].reshape(p, p), v[p * p : -1], int(round(v[-1]))


def covariance(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sample covariance, means, n)"""
    g, s, n = gram(df)
    return (g - np.outer(s, s) / max(n, 1)) / max(n - 1, 1), s / max(n, 1), n


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components) of the k largest; each component's largest coefficient is positive."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:k]
    c = v[:, order].T
    return w[order], c * np.sign(c[np.arange(len(c)), np.abs(c).argmax(1)])[:, None]


def inverse(cov: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    c = cov + ridge * np.eye(len(cov))
    try:
        return np.linalg.inv(c)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(c)


def _concentrated(x: np.ndarray, rows: np.ndarray, h: int, turns: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, covariance, centre) after concentration steps over ``x`` that begin with ``rows``."""
    for _ in range(turns):
        cov, mean = np.cov(x[rows], rowvar=False).reshape(x.shape[1], x.shape[1]), x[rows].mean(0)
        gap = x - mean
        rows = np.argpartition((gap @ inverse(cov, 1e-9) * gap).sum(1), h - 1)[:h]
    cov, mean = np.cov(x[rows], rowvar=False).reshape(x.shape[1], x.shape[1]), x[rows].mean(0)
    return float(np.linalg.slogdet(cov + 1e-12 * np.eye(len(cov)))[1]), cov, mean


def best_start(df: DataFrame, features: list[str], support: float, starts: int = STARTS, most: int = START_ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray] | None:
    """The concentrated (covariance, centre) of least determinant among many starts, on at most ``most`` rows drawn by hash.

    Every start is p + 1 random rows, so some are likely to hold no poison at all even if much of the table is poisoned.
    None with too few rows.
    """
    p = len(features)
    drawn = df.select(*features).orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(most)
    x = np.array([[0.0 if v is None else float(v) for v in r] for r in drawn.collect()], float).reshape(-1, p)  # a bounded sample
    h = int(np.ceil(support * len(x)))
    if h <= p + 1:
        return None
    rng = np.random.default_rng(seed)
    first = [_concentrated(x, rng.choice(len(x), p + 1, replace=False), h, 2) for _ in range(starts)]
    gap = lambda c: ((x - c[2]) @ inverse(c[1], 1e-9) * (x - c[2])).sum(1)
    refined = [_concentrated(x, np.argpartition(gap(c), h - 1)[:h], h, 20) for c in sorted(first, key=lambda c: c[0])[: max(1, starts // 10)]]
    _, cov, mean = min(refined, key=lambda c: c[0])
    return cov, mean


def robust_covariance(df: DataFrame, features: list[str], support: float = 0.8, turns: int = 10, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, centre) of the ``support`` share of rows whose covariance has the least determinant, reweighted.

    Starts are made on a bounded sample, the best of them is concentrated over all rows, and the rows that fit it (97.5 %
    of a normal table) give the result. ``starts`` 0 begins with all rows.
    """
    df = df.select(*features)
    cov, mean, n = covariance(df)
    start = best_start(df, features, support, starts) if starts else None
    cov, mean = start or (cov, mean)
    for _ in range(turns):
        d = squared_distance(df, features, mean, inverse(cov))
        cut = d.agg(F.approx_percentile("d2", support, 10_000).alias("q")).first()["q"]
        new, centre, _ = covariance(d.where(F.col("d2") <= cut).select(*features))
        if np.allclose(new, cov, rtol=1e-6, atol=1e-12):
            break
        cov, mean = new, centre
    # The kept rows are too narrow; scale so that the distances' median fits a chi-square variable's.
    p = len(features)
    chi = lambda z: p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3
    median = lambda c, m: squared_distance(df, features, m, inverse(c, 1e-12)).agg(F.approx_percentile("d2", 0.5, 10_000).alias("q")).first()["q"]
    cov = cov * (median(cov, mean) or 0.0) / chi(0.0)
    kept = squared_distance(df, features, mean, inverse(cov, 1e-12)).where(F.col("d2") <= chi(1.959964)).select(*features)
    new, centre, n = covariance(kept)
    return (new, centre) if n > p + 1 else (cov, mean)


def squared_distance(df: DataFrame, features: list[str], mean: np.ndarray, inv: np.ndarray, name: str = "d2") -> DataFrame:
    """``df`` with the squared Mahalanobis distance of each row, as one column expression over arrays."""
    gap = F.array(*[F.col(c) - float(m) for c, m in zip(features, mean, strict=True)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, u: t + u)
    rows = F.array(*[F.lit([float(v) for v in r]) for r in inv])
    turned = lambda x: dot(x, F.transform(rows, lambda r: dot(r, x)))
    return df.withColumn(name, F.get(F.transform(F.array(gap), turned), F.lit(0)))


def mahalanobis_of_medians(rows: DataFrame, features: list[str], scope: str = "union") -> DataFrame:
    """mahalanobis: distance of the scored medians from the reference medians, by the reference's robust covariance."""
    ref = rows.where("split = 'reference'")
    mine = rows if scope == "union" else rows.where("split = 'incoming'")
    med = lambda df: np.array([m for (m,) in quantiles.of_columns(df, features, [0.5]).values()])
    cov, _ = robust_covariance(ref, features)
    d = med(mine) - med(ref)
    return rows.sparkSession.createDataFrame([(float(np.sqrt(d @ inverse(cov) @ d)),)], "mahalanobis double")
