"""One-class machine over random Fourier features, fitted on all reference rows.

The problem min |w|^2 / 2 - rho + sum max(0, rho - w.z) / (nu n) has as its dual the point nearest to the origin among all
averages of rows in which no row weighs more than 1 / (nu n). The nearest point is found from few such averages (Wolfe's
method): a Spark job returns the average that lies lowest along the present point, the mean of the nu share of rows of
least score, and the present point moves to the nearest one in the hull of the averages kept. A job adds up rows by
ranges of scores, so that what it returns is always one of the averages allowed, at most a range from the lowest.

Rows are kept as they came; every job makes their random features anew, which take ``dims`` / p times the room.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.sources.tables import stored

#: Ranges of scores of a job, and the gap between the objective and its dual, relative to the first, that ends the fit.
RANGES, GAP = 256, 1e-3
#: Random features.
DIMS = 128


def lift(df: DataFrame, features: list[str], reference: Column, dims: int, seed: int) -> tuple[list[Column], Callable[[np.ndarray], np.ndarray]]:
    """The cells of a row, and what makes rows of them into cosines whose inner products are near the RBF kernel of scale 1 / (p x variance of all cells)."""
    p = len(features)
    cells = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    m = df.where(reference).agg(F.sum(sum((c for c in cells), F.lit(0.0))).alias("s"), F.sum(sum((c * c for c in cells), F.lit(0.0))).alias("q"), F.count("*").alias("n")).first()
    n = max(1, m["n"] * p)
    gamma = 1 / max(p * ((m["q"] or 0.0) / n - ((m["s"] or 0.0) / n) ** 2), 1e-9)
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((p, dims)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, dims)
    return cells, lambda x: np.cos(x @ w + b) * math.sqrt(2 / dims)


def _lowest(rows: DataFrame, lifted: Callable[[np.ndarray], np.ndarray], x: np.ndarray, nu: float) -> np.ndarray | None:
    """The mean of the ``nu`` share of rows that lie lowest along x; of the last range that is needed, its mean counts."""
    dims, reach = len(x), math.sqrt(2) * float(np.linalg.norm(x))  # no row is longer than sqrt(2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((RANGES, dims + 1))
        for batch in batches:
            z = lifted(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            at = np.clip(((z @ x) / reach + 1) / 2 * RANGES, 0, RANGES - 1).astype(int) if reach else np.zeros(len(z), int)
            order = np.argsort(at, kind="stable")
            own, first = np.unique(at[order], return_index=True)
            if len(own):
                total[own, :dims] += np.add.reduceat(z[order], first, axis=0)
                total[own, dims] += np.diff(np.append(first, len(z)))
        used = np.flatnonzero(total[:, dims])
        cell = (used[:, None] * (dims + 1) + np.arange(dims + 1)).ravel()
        yield pa.RecordBatch.from_pydict({"i": pa.array(cell, pa.int32()), "v": pa.array(total[used].ravel())})

    got = rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # at most RANGES x (dims + 1) numbers
    if not len(got):
        return None
    total = np.zeros(RANGES * (dims + 1))
    total[got["i"].to_numpy()] = got["v"].to_numpy()
    total = total.reshape(RANGES, dims + 1)
    n = total[:, dims]
    want = max(1.0, nu * n.sum())
    taken = np.clip(want - (np.cumsum(n) - n), 0, n)  # how many rows of each range
    share = np.divide(taken, n, out=np.zeros(RANGES), where=n > 0)
    return share @ total[:, :dims] / taken.sum()


def nearest_point(lowest: Callable[[np.ndarray], np.ndarray], first: np.ndarray, gap: float = GAP) -> np.ndarray:
    """The point nearest to the origin in the hull of what ``lowest`` returns, to a relative gap."""
    points, weights = [first], np.ones(1)
    while True:
        x = weights @ np.array(points)
        low = lowest(x)
        if x @ x - x @ low <= gap * (x @ x):
            return x
        points, weights = [*points, low], np.append(weights, 0.0)
        while True:
            p = np.array(points)
            k = len(p)
            m = np.zeros((k + 1, k + 1))
            m[0, 1:], m[1:, 0], m[1:, 1:] = 1.0, 1.0, p @ p.T
            best = np.linalg.lstsq(m, np.append(1.0, np.zeros(k)), rcond=None)[0][1:]  # nearest in the plane through all
            if (best > 1e-10).all():
                weights = best
                break
            out = best <= 1e-10
            step = min(1.0, float((weights[out] / np.maximum(weights[out] - best[out], 1e-300)).min()))
            weights = (1 - step) * weights + step * best
            keep = weights > 1e-10
            if keep.all():  # by rounding only
                keep[np.argmin(weights)] = False
            points, weights = [q for q, ok in zip(points, keep, strict=True) if ok], weights[keep] / weights[keep].sum()


def scored(df: DataFrame, features: list[str], reference: Column, nu: float, dims: int, seed: int) -> DataFrame:
    """``df`` with oneclass_score: minus the machine's inner product with the row. Without reference rows it is 0."""
    cells, lifted = lift(df, features, reference, dims, seed)
    own = stored(df.where(reference).select(*[c.alias(f"_{i}") for i, c in enumerate(cells)]), "oneclass")
    mean = _lowest(own, lifted, np.zeros(dims), 1.0)
    w = np.zeros(dims) if mean is None else nearest_point(lambda x: _lowest(own, lifted, x, nu), mean)

    def along(*v: pd.Series) -> pd.Series:
        return pd.Series(-(lifted(np.column_stack(v)) @ w)) if len(v[0]) else pd.Series([], dtype=float)

    return df.withColumn("oneclass_score", F.pandas_udf(along, "double")(*cells))
