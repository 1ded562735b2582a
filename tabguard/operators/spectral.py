"""Layer 2: spectral signatures of hidden triggers in activations.

A real activation column is the preferred input; from plain features, activations are drawn from a fixed random
projection that depends on the seed only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.numeric import norm
from tabguard.operators import linalg
from tabguard.sources.tables import stored

# Dimensions and thresholds.
DIMS, COMPONENTS, AMPLIFY, LABEL_WEIGHT = 32, 5, 2.0, 0.3
GAP_BASE, REFERENCE_FEATURES = 2.5, 8
MINORITY_MOST, TIGHTNESS_MOST, SILHOUETTE_LEAST, INERTIA_GAP, POINTS = 0.15, 0.5, 0.20, 0.08, 3
PROFILE_GAP = 3.0
#: Distinct points of a cluster that distances of silhouettes go to: all, or where there are more about so many by hash.
PAIRED = 10_000


def top_direction(df: DataFrame, features: list[str]) -> np.ndarray:
    cov, _, _ = linalg.covariance(df.select(*features))
    return linalg.principal(cov, 1)[1][0]


def activations(df: DataFrame, features: list[str], label: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``activation``: the top direction doubled, projected to 32 dimensions, tanh, label signal, unit norm."""
    way = top_direction(df, features)
    rng = np.random.default_rng(seed)
    projection, signal = rng.standard_normal((len(features), DIMS)), rng.standard_normal(DIMS) * LABEL_WEIGHT
    matrix = (np.eye(len(features)) + (AMPLIFY - 1) * np.outer(way, way)) @ projection
    lim = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first() if label else None
    lo, hi = (float(lim["lo"] or 0), float(lim["hi"] or 0)) if lim else (0.0, 0.0)

    def act(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.tanh(np.stack(x.to_numpy()) @ matrix) if len(x) else np.zeros((0, DIMS))
        if hi > lo:
            a = a + np.outer((y.fillna(lo).to_numpy(float) - lo) / (hi - lo + 1e-9) - 0.5, signal)
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        return pd.Series(list(a))

    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return df.withColumn("activation", F.pandas_udf(act, "array<double>")(vector, F.col(label).cast("double") if label else F.lit(0.0)))


def normalised(vector: Column) -> Column:
    """A vector divided by its length (at least 1e-9)."""
    return F.transform(vector, lambda v: v.cast("double") / F.greatest(norm(vector), F.lit(1e-9)))


def spectrum(df: DataFrame, vector: str = "activation") -> DataFrame:
    """spectral_gap, top_ratio, random_baseline and relative_gap of the (uncentred) matrix of vectors."""
    g, _, n = linalg.gram(df.select(F.col(vector).cast("array<double>")))
    gap, top, base = 1.0, 0.0, 1.0
    if n and len(g) > 1:
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
        if s[1] >= 1e-9:
            gap, top = float(s[0] / s[1]), float(s[0] ** 2 / ((s**2).sum() + 1e-9))
            base = float((np.sqrt(n) + np.sqrt(len(g))) / np.sqrt(len(g)))
    return df.sparkSession.createDataFrame([(n, gap, top, base, gap / max(base, 1.0))], "n long, spectral_gap double, top_ratio double, random_baseline double, relative_gap double")


def gap_threshold(n_features: Column) -> Column:
    return GAP_BASE * F.sqrt(n_features / REFERENCE_FEATURES)


def projected(df: DataFrame, vector: str, k: int = 2, out: str = "plane") -> DataFrame:
    """``df`` with its k leading principal coordinates."""
    cov, mean, _ = linalg.covariance(df.select(F.col(vector).cast("array<double>")))
    _, comps = linalg.principal(cov, k)
    x = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a - m)
    along = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(out, F.array(*[along(c) for c in comps]))


def clusters(df: DataFrame, plane: str = "plane", seed: int = 42) -> DataFrame:
    """``df`` with ``cluster`` of two."""
    rows = df.withColumn("_v", array_to_vector(plane))
    return KMeans(k=2, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=50).fit(rows).transform(rows)


def cluster_tightness(df: DataFrame, plane: str = "plane") -> DataFrame:
    """cluster, n, tightness (mean distance to the centre) of a frame with ``cluster``."""
    means = df.select("cluster", F.posexplode(plane).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # a row per cluster
    gap = F.aggregate(F.zip_with(plane, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    d = df.join(F.broadcast(centre), "cluster").select("cluster", F.sqrt(gap).alias("d"))
    return d.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("d").alias("tightness"))


def cluster_measures(df: DataFrame, plane: str = "plane") -> DataFrame:
    """minority_ratio, minority_count, tightness of a frame with ``cluster`` (exact, given the assignment)."""
    c = cluster_tightness(df, plane)
    return c.agg(F.min("n").alias("minority_count"), (F.min("n") / F.sum("n")).alias("minority_ratio"), F.min_by("tightness", F.struct("n", "cluster")).alias("tightness"))


def silhouettes(df: DataFrame, vector: str = "plane", most: int = PAIRED) -> DataFrame:
    """cluster, point, n, silhouette of every distinct point of a frame with ``cluster``, by Euclidean distances.

    The mean distance to the nearest other cluster less that to the point's own, over the larger of the two; 0 for a point
    that is alone in its cluster. Every point gets one. Distances go to all points of clusters with at most ``most``
    distinct points and are exact then; of a larger cluster, to about ``most`` that are drawn by hash.
    """
    points = stored(df.groupBy("cluster", F.col(vector).cast("array<double>").alias("point")).agg(F.count("*").alias("n")), "points")
    sizes = {r["cluster"]: r["n"] for r in points.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row per cluster
    if len(sizes) < 2:
        return points.withColumn("silhouette", F.lit(0.0))
    names = sorted(sizes)
    nth = reduce(lambda c, i: F.when(F.col("cluster") == names[i], i).otherwise(c), range(len(names)), F.lit(-1))
    least = reduce(lambda c, k: F.when(F.col("cluster") == k, -(-most * (1 << 20) // sizes[k])).otherwise(c), names, F.lit(0))
    rows = points.withColumns({"_c": nth, "_drawn": F.pmod(F.xxhash64("point"), F.lit(1 << 20)) < least})
    drawn = rows.where("_drawn").select("_c", "point", "n").toPandas()  # about ``most`` rows a cluster
    known = [(np.stack(g["point"].to_numpy()).astype(float), g["n"].to_numpy(float)) if len(g) else (None, None) for g in (drawn[drawn["_c"] == i] for i in range(len(names)))]
    shared = df.sparkSession.sparkContext.broadcast(known)

    def measure(point: pd.Series, own: pd.Series, inside: pd.Series) -> pd.Series:
        out = np.zeros(len(point))
        x, c = np.stack(point.to_numpy()).astype(float) if len(point) else np.zeros((0, 1)), own.to_numpy(int)
        for a in range(0, len(x), 128):
            part = x[a : a + 128]
            mean = np.full((len(shared.value), len(part)), np.inf)
            alone = np.zeros(len(part), bool)
            for i, (y, n) in enumerate(shared.value):
                if y is None:
                    continue
                gap = np.zeros((len(part), len(y)))
                for j in range(x.shape[1]):
                    gap += (part[:, j, None] - y[None, :, j]) ** 2
                mine = c[a : a + 128] == i
                rest = n.sum() - (mine & inside.to_numpy()[a : a + 128])  # without the point itself
                alone |= mine & (rest <= 0)
                mean[i] = np.sqrt(gap) @ n / np.maximum(rest, 1)
            at = np.arange(len(part))
            to_own = mean[c[a : a + 128], at]
            mean[c[a : a + 128], at] = np.inf
            other = mean.min(0)
            out[a : a + 128] = np.where(alone, 0.0, (other - to_own) / np.maximum(np.maximum(other, to_own), 1e-300))
        return pd.Series(out)

    return rows.select("cluster", "point", "n", F.pandas_udf(measure, "double")("point", "_c", "_drawn").alias("silhouette"))


def silhouette(df: DataFrame, vector: str = "plane", most: int = PAIRED) -> DataFrame:
    """One row: the mean silhouette of all rows; 0 with fewer than two clusters."""
    s = silhouettes(df, vector, most)
    return s.agg(F.coalesce(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("silhouette"))


def cluster_analysis(df: DataFrame, plane: str = "plane", seed: int = 42) -> DataFrame:
    """One row: minority_ratio, minority_count, tightness, inertia_gap, silhouette."""
    rows = df.withColumn("_v", array_to_vector(plane))
    model = KMeans(k=2, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=50).fit(rows)
    out = model.transform(rows)
    n = sum(model.summary.clusterSizes)
    one = rows.select(F.posexplode(plane).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("v")).first()["v"] * n
    gap = (one - model.summary.trainingCost) / (one + 1e-9)
    return cluster_measures(out, plane).withColumn("inertia_gap", F.lit(float(gap))).crossJoin(F.broadcast(silhouette(out, plane)))


def cluster_analysis_twice(df: DataFrame, vector: str, features: list[str], seed: int = 42) -> DataFrame:
    """The cluster analysis on the plane of the activations and on that of the features; the one with the smaller minority, the first of equals."""
    plane = lambda v: projected(df.withColumn("_own", v), "_own")
    own = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    passes = [cluster_analysis(plane(v), "plane", seed).withColumn("plane", F.lit(name)).withColumn("nth", F.lit(i)) for i, (name, v) in enumerate((("activations", F.col(vector)), ("features", own)))]
    both = passes[0].unionByName(passes[1])
    best = both.agg(F.min_by(F.struct(*both.columns), F.struct("minority_ratio", "nth")).alias("r"))
    return best.select("r.*").drop("nth")


def _scaled(value: Column, zero: Column | float, spread: float) -> Column:
    return 1 / (1 + F.exp(-(value - zero) / spread * 3))


def fused(m: DataFrame) -> DataFrame:
    """Suspicion from relative_gap, gap_threshold, minority_ratio, minority_count, tightness, inertia_gap, silhouette."""
    points = F.col("minority_count") >= POINTS
    a1 = F.col("relative_gap") > F.col("gap_threshold")
    a2 = (F.col("minority_ratio") < MINORITY_MOST) & (F.col("inertia_gap") > INERTIA_GAP) & points
    a3 = (F.col("tightness") < TIGHTNESS_MOST) & points
    a4 = F.col("silhouette") > SILHOUETTE_LEAST
    fired = a1.cast("int") + a2.cast("int") + a3.cast("int") + a4.cast("int")
    w = 0.35 * _scaled(F.col("relative_gap"), F.col("gap_threshold"), 2.0) + 0.25 * _scaled(MINORITY_MOST - F.col("minority_ratio"), 0.0, 0.1) + 0.25 * _scaled(TIGHTNESS_MOST - F.col("tightness"), 0.0, 0.3) + 0.15 * _scaled(F.col("silhouette") - SILHOUETTE_LEAST, 0.0, 0.2)
    score = F.when(fired == 4, F.least(F.lit(1.0), w)).when(fired == 3, F.least(F.lit(0.5), F.greatest(F.lit(0.15), w * 0.5))).otherwise(F.least(fired * 0.10, F.lit(0.35)))
    return m.withColumns({"signals_fired": fired, "backdoor_detected": fired == 4, "partial_backdoor": fired >= 3, "suspicion_score": score})


def suspicious_members(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """The first members of the smaller cluster (variant profile)."""
    small = df.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("n", "cluster").limit(1).select("cluster")
    return df.join(F.broadcast(small), "cluster", "left_semi").orderBy(*order_by).limit(n)


def cluster_profile(df: DataFrame, vector: str = "activation", seed: int = 42) -> DataFrame:
    """Variant, one row: spectral_gap, minority_count, minority_ratio, tightness (the tightest cluster of two rows or
    more), explained_variance of up to five components, suspicion_score, backdoor_detected, alarm."""
    cov, _, n = linalg.covariance(df.select(F.col(vector).cast("array<double>")))
    k = max(1, min(COMPONENTS, len(cov), n - 1))
    values = linalg.principal(cov, k)[0] / max(float(np.trace(cov)), 1e-300)
    c = clusters(projected(df, vector, k), "plane", seed)
    sizes = cluster_measures(c).select("minority_count", "minority_ratio")
    tight = cluster_tightness(c, "plane").where("n > 1").agg(F.coalesce(F.min("tightness"), F.lit(0.0)).alias("tightness"))
    out = spectrum(df, vector).select("spectral_gap").crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(tight))
    return profiled(out.withColumn("explained_variance", F.array(*[F.lit(float(v)) for v in values])))


def profiled(m: DataFrame) -> DataFrame:
    """Variant: suspicion_score, backdoor_detected and alarm from spectral_gap, minority_ratio, tightness."""
    gap, ratio, tight = F.col("spectral_gap"), F.col("minority_ratio"), F.col("tightness")
    score = F.least(gap / 10, F.lit(0.5)) * 0.4 + F.greatest(F.lit(0.0), MINORITY_MOST - ratio) / MINORITY_MOST * 0.4 + F.greatest(F.lit(0.0), 1 - tight) * 0.2
    found = (gap > PROFILE_GAP) & (ratio < MINORITY_MOST) & (tight < TIGHTNESS_MOST)
    return m.withColumn("suspicion_score", F.least(F.lit(1.0), score)).withColumn("backdoor_detected", found).withColumn("alarm", found | (F.col("suspicion_score") > 0.5))
