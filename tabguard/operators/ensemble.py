"""Layer 3: row-wise outlier detectors, their vote, and the query-pattern test.

Every detector adds one boolean column; frames keep one row per input row, told apart by ``key``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import clip
from tabguard.operators import boosting, forest, linalg, oneclass, quantiles
from tabguard.operators.neighbours import density_clusters, density_noise, nearest, neighbour_counts
from tabguard.operators.ranks import hashed_order
from tabguard.sources.tables import stored

# Contamination, vote and pattern thresholds.
CONTAMINATION, VOTE_SHARE, CLEAN_RATE, SCALE = 0.05, 0.75, 0.05, 0.30
TREES, PER_TREE = 200, 256
NEAR, PATTERN_ALARM = 0.05, 0.45
#: Rows whose pairwise distances tell how even a table is.
PAIRED = 1000


def robust_scale(df: DataFrame, features: list[str], reference: Column | None = None) -> DataFrame:
    """(x - median) / IQR by the reference rows; an IQR of 0 counts as 1."""
    q = quantiles.of_columns(df, features, [0.25, 0.5, 0.75], reference)
    scaled = lambda c, a, m, b: (F.col(c) - F.lit(m)) / (F.lit(b) - F.lit(a) if a != b else F.lit(1.0))
    return df.withColumns({c: scaled(c, *q[c]) for c in features})


# ---- isolation forest (E2) -------------------------------------------------------------------------------------------


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int, most: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    lo, hi = x.min(0), x.max(0)
    wide = np.flatnonzero(hi > lo)
    if depth >= most or len(x) <= 1 or not len(wide):
        nodes[at] = (-1, 0.0, -1, -1, depth + _path(len(x)))
        return at
    f = int(rng.choice(wide))
    cut = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < cut
    a = _tree(x[left], rng, depth + 1, most, nodes)
    b = _tree(x[~left], rng, depth + 1, most, nodes)
    nodes[at] = (f, cut, a, b, 0.0)
    return at


def _path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, features: list[str], keys: list[str], reference: Column, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 42) -> DataFrame:
    """``df`` with isolation_score and isolation_flag (above the reference's 95th percentile).

    Reference rows are drawn by hash once, about 2 x trees x per_tree of them however many there are (few rows are
    drawn several times), and dealt to trees; each tree grows in its own group from at most ``per_tree`` rows. The node
    table is small (trees x per_tree rows) and goes to every scoring task.
    """
    n = max(1, df.where(reference).count())
    wanted = 2 * trees * per_tree  # twice what the trees take, so that few of them fall short by chance
    copies = min(trees, -(-wanted // n))
    pool = df.where(reference).select(*[F.col(c).cast("double").alias(c) for c in features], hashed_order(keys, seed).alias("_h"))
    if wanted < n:
        pool = pool.where(F.pmod("_h", F.lit(1_000_000)) < math.ceil(1_000_000 * wanted / n))
    drawn = pool.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("_o", F.xxhash64("_h", "_i"))
    drawn = drawn.withColumn("tree", F.pmod("_o", F.lit(trees)).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_o")[features].fillna(0.0).to_numpy(float)[:per_tree]
        nodes: list = []
        _tree(x, np.random.default_rng([seed, t]), 0, math.ceil(math.log2(max(2, per_tree))), nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", t)
        return out

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, depth double").orderBy("tree", "node").toPandas()  # at most 2 x trees x per_tree rows
    grown = [g[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in forest.groupby("tree")]
    typical = _path(min(per_tree, max(n, 2)))
    shared = df.sparkSession.sparkContext.broadcast(grown)

    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.nan_to_num(np.stack(v.to_numpy()).astype(float))
        total = np.zeros(len(x))
        for g in shared.value:
            at = np.zeros(len(x), int)
            while True:
                f = g[at, 0].astype(int)
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                at[go] = np.where(x[go, f[go]] < g[at[go], 1], g[at[go], 2], g[at[go], 3]).astype(int)
            total += g[at, 4]
        return pd.Series(2.0 ** (-total / max(len(shared.value), 1) / max(typical, 1e-9)))

    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    scored = df.withColumn("isolation_score", F.pandas_udf(score, "double")(vector))
    return _flag_above(scored, "isolation_score", "isolation_flag", reference)


def _flag_above(df: DataFrame, score: str, flag: str, reference: Column, at: float = 1 - CONTAMINATION) -> DataFrame:
    df = stored(df, "scored")  # scores are read several times
    return df.withColumn(flag, F.col(score) > quantiles.of_column(df, score, at, reference))


# ---- one-class support, ellipse, positive-unlabelled models (E3, E7, E8, E9) --------------------------------------------


def one_class(df: DataFrame, features: list[str], reference: Column, nu: float = CONTAMINATION, dims: int = oneclass.DIMS, seed: int = 42) -> DataFrame:
    """``df`` with oneclass_score and oneclass_flag: rows outside the one-class machine that leaves out a share ``nu`` of the reference.

    The RBF kernel is approximated by ``dims`` random Fourier features; the machine's offset is the reference's
    quantile of scores.
    """
    return _flag_above(oneclass.scored(df, features, reference, nu, dims, seed), "oneclass_score", "oneclass_flag", reference, 1 - nu)


def elliptic(df: DataFrame, features: list[str], reference: Column, support: float = 0.85) -> DataFrame:
    """``df`` with elliptic_flag: robust squared distance above the reference's 95th percentile."""
    cov, mean = linalg.robust_covariance(df.where(reference), features, support)
    return _flag_above(linalg.squared_distance(df, features, mean, linalg.inverse(cov), "elliptic_score"), "elliptic_score", "elliptic_flag", reference)


def positive_unlabelled(df: DataFrame, features: list[str], keys: list[str], reference: Column, kind: str = "gbt", rounds: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with {kind}_flag: rows less like the reference than its 5th percentile, by trees that tell the reference
    from even noise in its bounding box (widened by 0.5)."""
    ref = df.where(reference)
    lim = ref.agg(*[F.struct((F.min(c) - 0.5).alias("lo"), (F.max(c) + 0.5).alias("hi")).alias(f"_{c}") for c in features])
    u = lambda i: F.pmod(hashed_order(keys, seed + i), F.lit(1_000_003)) / 1_000_003
    noise = ref.crossJoin(F.broadcast(lim)).select(*[(F.col(f"_{c}.lo") + u(i) * (F.col(f"_{c}.hi") - F.col(f"_{c}.lo"))).alias(c) for i, c in enumerate(features)], F.lit(0.0).alias("_y"))
    train = ref.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features] if kind != "gbt" else features, F.lit(1.0).alias("_y")).unionByName(noise)
    if kind == "gbt":
        cuts = boosting.cut_points(train, features)
        given = train.select(*features, F.lit(0).alias("fold"), F.col("_y").alias("y"), F.lit(False).alias("flagged"))
        model = boosting.fit(boosting.equal(given, features, cuts), cuts, [(0, -1, 1)], rounds, rate=0.3)[0]  # no fold is left out
        out = boosting.scored(df, features, model, "gbt_score").withColumn("gbt_score", -F.col("gbt_score"))
        return _flag_above(out, "gbt_score", "gbt_flag", reference)
    trees = forest.fit(train, features, rounds, seed=seed)

    def probability(*v: pd.Series) -> pd.Series:
        return pd.Series(trees.margins(trees.codes(np.column_stack(v).astype(float)))) if len(v[0]) else pd.Series([], dtype=float)

    out = df.withColumn(f"{kind}_score", -F.pandas_udf(probability, "double")(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
    return _flag_above(out, f"{kind}_score", f"{kind}_flag", reference)


# ---- neighbours (E4, E5, E6, E16) ----------------------------------------------------------------------------------------


def local_outlier_factor(df: DataFrame, others: DataFrame, features: list[str], key: str, k: int = 20) -> DataFrame:
    """key, lof of each row of ``df`` against ``others``."""
    own = stored(nearest(others, others, features, key, k), "neighbours")
    reach = own.groupBy("key").agg(F.max("distance").alias("kd"))
    density = own.join(reach.select(F.col("key").alias("other"), "kd"), "other").groupBy("key").agg((1 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))
    mine = nearest(df, others, features, key, k)
    facts = reach.join(density, "key").select(F.col("key").alias("other"), "kd", "lrd")
    return mine.join(facts, "other").groupBy("key").agg((F.avg("lrd") * (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lof"))


def estimate_eps(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """eps: 90th percentile of the distance to the 5th neighbour, the row itself counted; at least 0.1."""
    fifth = nearest(df, df, features, key, 4).groupBy("key").agg(F.max("distance").alias("d"))
    return quantiles.percentiles(stored(fifth, "distances"), [], "d", [0.9]).select(F.greatest(F.get("q", F.lit(0)), F.lit(0.1)).alias("eps"))


# ---- tails and vote (E10-E17) --------------------------------------------------------------------------------------------


def tail_scores(long: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """key, copod: sum over features of -ln min(F, 1 - F) with F the reference's distribution function.

    ``long`` has key, split, feature, value. Values are added up per feature, and running counts go within ranges of about
    equal weight, from the counts of the ranges before, so no window holds a whole feature.
    """
    known = long.where("value IS NOT NULL")
    cells = known.groupBy("feature", "value").agg(F.count_if(F.col("split") == "reference").alias("r"))
    cuts = known.groupBy("feature").agg(F.approx_percentile("value", [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    cut = cells.join(F.broadcast(cuts), "feature").withColumn("bucket", F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("value") >= c).cast("int"))).drop("cuts")
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    part = cut.groupBy("feature", "bucket").agg(F.sum("r").alias("br"))
    part = part.select("feature", "bucket", F.coalesce(F.sum("br").over(before), F.lit(0)).alias("r0"), F.sum("br").over(Window.partitionBy("feature")).alias("nr"))
    w = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    f = cut.join(F.broadcast(part), ["feature", "bucket"]).select("feature", "value", ((F.col("r0") + F.sum("r").over(w)) / F.col("nr")).alias("f"))
    f = f.withColumn("f", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("f")))).select("feature", "value", (-F.log(F.least("f", 1 - F.col("f")))).alias("t"))
    return known.join(f, ["feature", "value"]).groupBy(key).agg(F.sum("t").alias("copod"))


def tail_flags(scores: DataFrame, at: float = 1 - CONTAMINATION) -> DataFrame:
    """copod_flag: above the scored rows' own 95th percentile."""
    scores = stored(scores, "scored")
    return scores.withColumn("copod_flag", F.col("copod") > quantiles.of_column(scores, "copod", at))


def vote(df: DataFrame, flags: list[str], share: float = VOTE_SHARE) -> DataFrame:
    """``df`` with votes, flagged (votes >= max(2, ceil(share x detectors))) and ensemble_score."""
    votes = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])
    return df.withColumn("votes", votes).withColumn("flagged", F.col("votes") >= max(2, math.ceil(share * len(flags)))).withColumn("ensemble_score", F.when(F.col("flagged"), 1.0).otherwise(0.1))


def layer_score(df: DataFrame) -> DataFrame:
    """n, flagged_count, flagged_ratio, suspicion_score."""
    out = df.agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged_count"), F.avg(F.col("flagged").cast("double")).alias("flagged_ratio"))
    return out.withColumn("suspicion_score", clip((F.col("flagged_ratio") - CLEAN_RATE) / SCALE))


def per_detector(df: DataFrame, flags: list[str]) -> DataFrame:
    long = df.unpivot([], [F.col(f).cast("int").alias(f) for f in flags], "detector", "flag")
    return long.groupBy("detector").agg(F.sum("flag").alias("flagged_count"), F.avg("flag").alias("flagged_ratio"))


def weighted_vote(df: DataFrame, weights: dict[str, float], flags: list[str]) -> DataFrame:
    """Variant: ensemble_score of scores that are normalised as (-s - min) / (max - min + 1e-8), and the agreement rate."""
    lim = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in weights])
    s = reduce(lambda a, b: a + b, [w * (-F.col(c) - F.col(f"_{c}.lo")) / (F.col(f"_{c}.hi") - F.col(f"_{c}.lo") + 1e-8) for c, w in weights.items()])
    agree = reduce(lambda a, b: a + b, [F.col(f).cast("double") for f in flags]) / len(flags)
    return df.crossJoin(F.broadcast(lim)).withColumn("ensemble_score", s).withColumn("agreement", agree).withColumn("flagged", F.col("ensemble_score") > 0.5).drop(*[f"_{c}" for c in weights])


def bounded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows by hash, for fitting; never for scoring."""
    return df.orderBy(hashed_order(keys, seed), *keys).limit(n)


# ---- query patterns (E18-E23) --------------------------------------------------------------------------------------------


def pattern_reference(df: DataFrame, features: list[str], reference: Column) -> DataFrame:
    """One row: per feature iqr and centre (median over iqr), and the 25th and 80th percentile of reference distances."""
    q = quantiles.of_columns(df, features, [0.25, 0.5, 0.75], reference)
    wide = {c: max(b - a, 1e-6) + 1e-9 for c, (a, _, b) in q.items() if a is not None}
    nulls = F.lit(None).cast("double")
    iqr = [(F.lit(wide[c]) if c in wide else nulls).alias(f"iqr_{c}") for c in features]
    mid = [(F.lit(q[c][1] / wide[c]) if c in wide else nulls).alias(f"mid_{c}") for c in features]
    one = df.sparkSession.range(1).select(*iqr, *mid)
    p25, p80 = quantiles.of_columns(centre_distance(df.where(reference), one, features).select("distance"), ["distance"], [0.25, 0.8])["distance"]
    return one.withColumns({"p25": F.lit(p25).cast("double"), "p80": F.lit(p80).cast("double")})


def centre_distance(df: DataFrame, ref: DataFrame, features: list[str]) -> DataFrame:
    parts = [F.pow(F.col(c) / F.col(f"iqr_{c}") - F.col(f"mid_{c}"), 2) for c in features]
    return df.crossJoin(F.broadcast(ref)).withColumn("distance", F.sqrt(reduce(lambda a, b: a + b, parts)))


def near_duplicate_rate(df: DataFrame, features: list[str], key: str, eps: float = NEAR) -> DataFrame:
    """Share of rows with another row closer than eps (features scaled already)."""
    counts = neighbour_counts(df, features, key, eps)
    return counts.agg(F.avg((F.col("n") > 1).cast("double")).alias("near_duplicate_rate"))


def pattern_signals(df: DataFrame, ref: DataFrame, features: list[str]) -> DataFrame:
    """boundary and tail: shares of rows inside the inner and beyond the outer reference distance."""
    d = centre_distance(df, ref, features)
    return d.agg(F.avg((F.col("distance") < F.col("p25")).cast("double")).alias("boundary"), F.avg((F.col("distance") > F.col("p80")).cast("double")).alias("tail"))


def uniformity(df: DataFrame, features: list[str], key: str, most: int = PAIRED) -> DataFrame:
    """cv: deviation over mean of the pairwise distances of the rows, of ``most`` of them drawn by hash where there are more."""
    sample = bounded_sample(df, [key], most)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    a, b = sample.select(F.col(key).alias("a"), vec.alias("x")), sample.select(F.col(key).alias("b"), vec.alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).agg((F.stddev_pop(d) / (F.avg(d) + 1e-9)).alias("cv"))


def pattern_score(m: DataFrame) -> DataFrame:
    """suspicion_score and alarm from near_duplicate_rate, boundary, cv, tail."""
    one, zero = F.lit(1.0), F.lit(0.0)
    s = 0.3 * F.least(F.col("near_duplicate_rate") / 0.15, one) + 0.2 * F.least(F.col("boundary") / 0.15, one) + 0.3 * F.greatest(zero, 1 - F.col("cv") / 0.5) + 0.2 * F.least(F.greatest(zero, F.col("tail") - 0.2) / 0.1, one)
    return m.withColumn("suspicion_score", clip(s)).withColumn("alarm", F.col("suspicion_score") >= PATTERN_ALARM)


