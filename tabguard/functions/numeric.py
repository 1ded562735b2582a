"""Column expressions and tail probabilities shared by the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def sigmoid(value: Column, threshold: float, spread: float) -> Column:
    """1 / (1 + exp(-(value - threshold) / spread))"""
    return 1 / (1 + F.exp(-(value - threshold) / max(spread, 1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is (almost) zero."""
    return F.when((norm(a) < 1e-9) | (norm(b) < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unpivot(df, features: list[str], keep: list[str]):
    """(keep, feature, value): one row per feature."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c).cast("double").alias(c) for c in features], "feature", "value")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if abs(1 + num * d) > 1e-300 else 1e300
        c = 1 + num / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def binomial_tail(k: float, n: float, p: float) -> float:
    """P(X >= k) of a binomial variable."""
    return 1.0 if k <= 0 else _beta_tail(k, n - k + 1, p) if k <= n else 0.0


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def _binomial_tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((binomial_tail(*x) for x in zip(k, n, p, strict=True)), float, len(k)))


def binomial_tail_udf(k: Column, n: Column, p: Column) -> Column:
    return F.pandas_udf(_binomial_tails, "double")(k, n, p)
