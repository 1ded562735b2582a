"""Drift of feature attributions over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import causal

# Alarm threshold of a step, and of the drift since the first batch in steps.
STEP, CUMULATIVE = 0.15, 5


def attribution(df: DataFrame, coefficients: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` with each feature replaced by its share |x coef| / (sum over features + 1e-8)."""
    parts = {c: F.abs(F.col(c) * w) for c, w in coefficients.items()}
    total = sum(list(parts.values())[1:], list(parts.values())[0]) + 1e-8
    return df.select(*keep, *[(p / total).alias(c) for c, p in parts.items()])


def fitted_coefficients(df: DataFrame, features: list[str], label: str, keys: list[str], batch: str = "batch") -> dict[str, float]:
    """The coefficients of a logistic model of the first batch, in order, that has rows of both classes; 0 where none has."""
    both = df.where(F.col(label).isNotNull()).groupBy(batch).agg(F.count_distinct(label).alias("n")).where("n > 1").agg(F.min(batch).alias("b")).first()["b"]
    if both is None:
        return dict.fromkeys(features, 0.0)
    own = df.where(F.col(batch) == F.lit(both)).withColumn("_none", F.lit(False))
    beta, _ = causal.fit(own, features, label, "_none", keys, [("full", 0, 0, -1)])
    return {c: float(b) for c, b in zip(features, beta[0], strict=False)}


def snapshots(shares: DataFrame, features: list[str], batch: str = "batch") -> DataFrame:
    """batch, feature, mean, sigma (population), n."""
    return unpivot(shares, features, [batch]).groupBy(batch, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"), F.count("*").alias("n"))


def merged(parts: DataFrame, batch: str = "batch") -> DataFrame:
    """Snapshots of parts of the same batch and feature as one: counts add up, sigma from within and between the parts."""
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    both = parts.join(parts.groupBy(batch, "feature").agg(mean.alias("_mean")), [batch, "feature"])
    spread = F.sum(F.col("n") * (F.col("sigma") ** 2 + (F.col("mean") - F.col("_mean")) ** 2)) / F.sum("n")
    return both.groupBy(batch, "feature").agg(F.first("_mean").alias("mean"), F.sqrt(spread).alias("sigma"), F.sum("n").alias("n"))


def drift(snaps: DataFrame, batch: str = "batch", step: float = STEP, cumulative: float = CUMULATIVE) -> DataFrame:
    """Per batch but the first: step_drift, cumulative_drift since the first batch, worst_feature, score, alarm."""
    w = Window.partitionBy("feature").orderBy(batch)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = lambda m, s: F.abs(F.col("mean") - m) + F.abs(F.col("sigma") - s)
    rows = snaps.select(
        batch, "feature", F.row_number().over(w).alias("nth"),
        F.round(moved(F.lag("mean").over(w), F.lag("sigma").over(w)), 4).alias("d"),
        moved(F.first("mean").over(every), F.first("sigma").over(every)).alias("c"),
    ).where("nth > 1")
    out = rows.groupBy(batch).agg(F.avg("d").alias("step_drift"), F.avg(F.when(F.col("nth") > 2, F.col("c")).otherwise(0.0)).alias("cumulative_drift"), F.min_by("feature", F.struct(-F.col("d"), F.col("feature"))).alias("worst_feature"))
    score = F.least(F.lit(1.0), F.greatest(F.col("step_drift") / step, F.col("cumulative_drift") / (step * cumulative)))
    return out.withColumn("suspicion_score", score).withColumn("alarm", (F.col("step_drift") > step) | (F.col("cumulative_drift") > step * cumulative))


def windowed_wasserstein(snaps: DataFrame, batch: str = "batch", width: int = 5) -> DataFrame:
    """Variant: per batch and feature, W1 between the means of the last ``width`` batches and of the ``width`` before the newest."""
    w = Window.partitionBy("feature").orderBy(batch)
    now = F.sort_array(F.collect_list("mean").over(w.rowsBetween(-(width - 1), 0)))
    was = F.sort_array(F.collect_list("mean").over(w.rowsBetween(-width, -1)))
    both = snaps.select(batch, "feature", now.alias("a"), was.alias("b")).where((F.size("a") == width) & (F.size("b") == width))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / width
    return both.select(batch, "feature", gap.alias("w1"))
