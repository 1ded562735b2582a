"""Layer 4: does accuracy rise when the flagged rows are left out, and what do those rows look like?

All logistic models - every fold of every replicate, with and without the flagged rows - are fitted together: one
Spark job per Newton step sums gradients and Hessians for all of them, and only those sums reach the driver.
Replicates are Poisson weights and placebo removals by hash of the row, so a fold is a property of the row and results
do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.functions.numeric import clip, t_two_sided, unpivot
from tabguard.operators import boosting
from tabguard.operators.ranks import hashed_order, with_rank

# Folds, replicates and thresholds of the proof and of fingerprints.
FOLDS, REPLICATES, PLACEBOS = 3, 100, 5
LEAST_EFFECT, P_MOST, PLACEBO_MOST = 0.01, 0.05, 0.20
LABEL_DELTA, TIGHT_RATIO, SPIKE_LIFT, FEATURE_Z, Z_FEATURES, HOMOGENEITY = 0.15, 2.5, 3.0, 2.0, 2, 0.60
CONFIRMED, SUSPECTED = 0.70, 0.40
#: Added before rounding, so that decimal ties go up whatever their binary form.
TIE = 1e-9

#: Products of models and rows that a task holds at once.
CELLS = 1 << 18
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))


def with_fold(df: DataFrame, keys: list[str], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``df`` with _hash and _fold; folds are even within every class but for chance."""
    return df.withColumn("_hash", hashed_order(keys, seed)).withColumn("_fold", F.pmod(F.xxhash64("_hash"), F.lit(folds)).cast("int"))


def stratified_fold(df: DataFrame, keys: list[str], label: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``df`` with _fold: rows of each class dealt evenly, by hash, to as many folds as the smallest class has rows, ``folds`` at most.

    With fewer than two in the smallest class there are no folds: _fold is 0 for about 30 % of the rows (the held-out
    part) and 1 for the others. Null labels count as a class of their own.
    """
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"] or 0
    k = min(folds, smallest)
    hashed = df.withColumn("_hash", hashed_order(keys, seed))
    if k < 2:
        return hashed.withColumn("_fold", F.when(F.pmod("_hash", F.lit(10)) < 3, 0).otherwise(1)).drop("_hash")
    # Rows of a class follow each other in this order, so their positions leave every remainder about equally often.
    return with_rank(hashed, [label, "_hash", *keys], "_nth").withColumn("_fold", F.pmod("_nth", F.lit(k)).cast("int")).drop("_hash", "_nth")


def plan(replicates: int = REPLICATES, placebos: int = PLACEBOS, folds: int = FOLDS) -> list[tuple[str, int, int, int]]:
    """(kind, replicate, arm, fold): full, bootstrap and placebo fits; arm 1 leaves rows out."""
    runs = [("full", 0)] + [("bootstrap", r) for r in range(1, replicates + 1)] + [("placebo", r) for r in range(1, placebos + 1)]
    return [(k, r, a, f) for k, r in runs for a in (0, 1) for f in range(folds)]


def _mixed(h: np.ndarray, salts: list[int]) -> np.ndarray:
    """An even number in [0, 1) of each salt (row) and hash (column)."""
    x = h.view(np.uint64) + np.array([s * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for s in salts], np.uint64)[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def _weights(arms: list[tuple], h: np.ndarray, flagged: np.ndarray, share: float) -> np.ndarray:
    """The weight of each row (column) in each (kind, replicate, arm)."""
    draws = list(dict.fromkeys(r for kind, r, _ in arms if kind == "bootstrap"))
    u = _mixed(h, draws)
    counts = np.zeros(u.shape)
    for c in _POISSON:
        counts += u >= c
    drawn = dict(zip(draws, counts, strict=True))
    w = np.ones((len(arms), len(h)))
    for i, (kind, r, arm) in enumerate(arms):
        if kind == "bootstrap":
            w[i] = drawn[r]
        if arm:
            w[i] *= ~(flagged if kind != "placebo" else _mixed(h, [1000 + r])[0] < share)
    return w


def _blocks(batches: Iterator[pa.RecordBatch], models: list, share: float, held_out: bool) -> Iterator[tuple]:
    """(models, x, y, weights): rows of one fold, and the models that leave this fold out (or else those that train on it)."""
    arms = list(dict.fromkeys(m[:3] for m in models))
    arm, own = np.array([arms.index(m[:3]) for m in models]), np.array([m[3] for m in models])
    for batch in batches:
        *x, y, flagged, h, fold = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = np.column_stack([*x, np.ones(len(y))])
        for f in np.unique(fold):
            mine, rows = np.flatnonzero((own == f) == held_out), np.flatnonzero(fold == f)
            size = max(1, CELLS // max(1, len(mine)))
            for at in range(0, len(rows) if len(mine) else 0, size):
                part = rows[at : at + size]
                yield mine, x[part], y[part], _weights(arms, h[part], flagged[part].astype(bool), share)[arm[mine]]


def _steps(batches: Iterator[pa.RecordBatch], models: list, beta: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    i, j = np.triu_indices(beta.shape[1])
    total = np.zeros((len(models), len(i) + beta.shape[1]))
    for mine, x, y, w in _blocks(batches, models, share, held_out=False):
        p = 1 / (1 + np.exp(-np.clip(beta[mine] @ x.T, -30, 30)))
        total[mine, : len(i)] += (w * p * (1 - p)) @ (x[:, i] * x[:, j])
        total[mine, len(i) :] += (w * (y - p)) @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(list(total))], names=["model", "sums"])


def _hits(batches: Iterator[pa.RecordBatch], models: list, beta: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    right, seen = np.zeros(len(models)), np.zeros(len(models))
    for mine, x, y, w in _blocks(batches, models, share, held_out=True):
        right[mine] += (w * ((beta[mine] @ x.T > 0) == (y > 0.5))).sum(1)
        seen[mine] += w.sum(1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(right), pa.array(seen)], names=["model", "correct", "seen"])


def fit(df: DataFrame, features: list[str], label: str, flagged: str, keys: list[str], models: list, steps: int = 6, ridge: float = 1.0) -> tuple[np.ndarray, DataFrame]:
    """(coefficients per model, frame of model, correct, seen). Ridge applies to all but the intercept.

    Folds are those of a column _fold, else by hash.
    """
    folded = df.withColumn("_hash", hashed_order(keys, 42)) if "_fold" in df.columns else with_fold(df, keys)
    rows = folded.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"), F.coalesce(F.col(flagged), F.lit(False)).alias("flagged"), "_hash", "_fold").where("y IS NOT NULL")
    share = rows.agg(F.coalesce(F.avg(F.col("flagged").cast("double")), F.lit(0.0)).alias("s")).first()["s"]
    q = len(features) + 1
    beta, penalty = np.zeros((len(models), q)), np.diag([ridge] * (q - 1) + [1e-9])
    upper = np.triu_indices(q)
    for _ in range(steps):
        sums = rows.mapInArrow(lambda b, beta=beta: _steps(b, models, beta, share), "model int, sums array<double>")
        found = sums.select("model", F.posexplode("sums").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v")).toArrow()  # models x (p x p + p) / 2 numbers
        added = np.zeros((len(models), len(upper[0]) + q))
        added[found["model"].to_numpy(), found["i"].to_numpy()] = found["v"].to_numpy()
        new = beta.copy()
        for m, s in enumerate(added):
            h = np.zeros((q, q))
            h[upper] = h.T[upper] = s[:-q]
            new[m] = beta[m] + np.linalg.solve(h + penalty, s[-q:] - penalty @ beta[m])
        done, beta = np.abs(new - beta).max() < 1e-8, new
        if done:
            break
    hits = rows.mapInArrow(lambda b: _hits(b, models, beta, share), "model int, correct double, seen double")
    return beta, hits.groupBy("model").agg(F.sum("correct").alias("correct"), F.sum("seen").alias("seen"))


def replicates(df: DataFrame, features: list[str], label: str, flagged: str, keys: list[str], n: int = REPLICATES, placebos: int = PLACEBOS, folds: int = FOLDS) -> DataFrame:
    """kind, replicate, accuracy_with, accuracy_without, effect."""
    models = plan(n, placebos, folds)
    _, hits = fit(stratified_fold(df, keys, label, folds), features, label, flagged, keys, models)
    names = df.sparkSession.createDataFrame([(i, k, r, a) for i, (k, r, a, _) in enumerate(models)], "model int, kind string, replicate int, arm int")
    acc = hits.where("seen > 0").join(F.broadcast(names), "model").groupBy("kind", "replicate", "arm").agg(F.avg(F.col("correct") / F.col("seen")).alias("acc"))
    both = acc.groupBy("kind", "replicate").agg(F.max(F.when(F.col("arm") == 0, F.col("acc"))).alias("accuracy_with"), F.max(F.when(F.col("arm") == 1, F.col("acc"))).alias("accuracy_without"))
    return both.withColumn("effect", F.col("accuracy_without") - F.col("accuracy_with"))


def tree_effect(df: DataFrame, features: list[str], label: str, flagged: str, keys: list[str], kind: str = "rf", size: int = 50, folds: int = FOLDS) -> DataFrame:
    """proxy, accuracy_with, accuracy_without, effect of a forest (rf) or boosted trees (gbt), on stratified folds.

    Boosted trees of all folds, arms and classes grow together, a Spark job per tree level. An arm whose rows have one
    class has accuracy 1, one without any held-out row 0.5.
    """
    rows = stratified_fold(df.where(F.col(label).isNotNull()), keys, label, folds)
    own = F.coalesce(F.col(flagged), F.lit(False))
    found = rows.groupBy("_fold").agg(F.count("*")).orderBy("_fold").collect()  # a row per fold
    held_out = [r["_fold"] for r in found if len(found) > 2 or r["_fold"] == 0 or folds == 2]
    n_classes = rows.agg(F.count_distinct(label), F.count_distinct(F.when(~own, F.col(label)))).first()
    if kind == "gbt":
        each = {(r["arm"], r["fold"]): r["correct"] / r["seen"] for r in boosting.accuracies(rows, features, label, flagged, held_out, size).collect() if r["seen"]}
    else:
        rows = rows.withColumn("_v", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))).withColumn("_y", F.col(label).cast("double"))
        model = RandomForestClassifier(numTrees=size, maxDepth=5, seed=42, featuresCol="_v", labelCol="_y")
        each = {}
        for arm in (0, 1):
            part = rows.where(~own) if arm else rows
            for f in held_out if n_classes[arm] > 1 else []:
                # The copy is without the training summary: that refers to the session, which no task can take once a query has been observed.
                got = model.fit(part.where(F.col("_fold") != f)).copy().transform(part.where(F.col("_fold") == f)).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
                each |= {} if got is None else {(arm, f): got}

    def accuracy(arm: int) -> float:
        mine = [v for (a, _), v in each.items() if a == arm]
        return 1.0 if n_classes[arm] < 2 else float(np.mean(mine)) if mine else 0.5

    a, b = accuracy(0), accuracy(1)
    return df.sparkSession.createDataFrame([(kind, a, b, b - a)], "proxy string, accuracy_with double, accuracy_without double, effect double")


def shuffled_placebo(reps: DataFrame, most: float = 0.3) -> DataFrame:
    """Variant: effect of the flagged rows, mean effect of as many rows under shuffled marks, and whether that is under ``most`` of it.

    ``reps`` comes from ``replicates``, whose placebo removals are masks of the same share by hash.
    """
    own, other = (F.avg(F.when(F.col("kind") == k, F.col("effect"))) for k in ("full", "placebo"))
    out = reps.agg(own.alias("effect"), F.coalesce(other, F.lit(0.0)).alias("placebo_effect"))
    return out.withColumn("placebo_valid", (F.col("effect") > 0) & (F.abs("placebo_effect") < most * F.col("effect")))


def row_effects(df: DataFrame, features: list[str], label: str, flagged: str, keys: list[str], ridge: float = 1.0) -> DataFrame:
    """Variant: the columns ``keys`` and effect of every flagged row: the fall of the other rows' mean log loss if it is left out.

    One logistic model is fitted on all rows; leaving one row out moves its coefficients by one Newton step, whose
    effect on the mean loss of rows that are not flagged is a product of sums that all rows share and the row's own
    gradient. So no model is fitted per row, and no number of rows needs a cap.
    """
    beta, _ = fit(df, features, label, flagged, keys, [("full", 0, 0, -1)], ridge=ridge)
    x = [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features], F.lit(1.0)]
    q = len(x)
    logit = sum((float(b) * v for b, v in zip(beta[0][1:], x[1:], strict=True)), float(beta[0][0]) * x[0])
    rows = df.withColumn("_p", 1 / (1 + F.exp(-logit))).withColumn("_y", F.col(label).cast("double")).where("_y IS NOT NULL")
    w, gap, mine = F.col("_p") * (1 - F.col("_p")), F.col("_p") - F.col("_y"), F.coalesce(F.col(flagged), F.lit(False))
    sums = rows.agg(*[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(q) for j in range(i, q)], *[F.avg(F.when(~mine, gap * x[i])).alias(f"g{i}") for i in range(q)]).first()
    h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(q)] for i in range(q)]) + np.diag([ridge] * (q - 1) + [1e-9])
    way = np.linalg.solve(h, np.array([sums[f"g{i}"] or 0.0 for i in range(q)]))
    # Without the row the coefficients move by H^-1 times its gradient.
    effect = -gap * sum((float(a) * v for a, v in zip(way[1:], x[1:], strict=True)), float(way[0]) * x[0])
    return rows.where(mine).select(*keys, effect.alias("effect"))


def proof(reps: DataFrame, effects: list[float]) -> DataFrame:
    """One row: causal_effect (median of proxies), its interval and p-value, placebo ratio, proof_valid, suspicion."""
    b = reps.where("kind = 'bootstrap'").agg(F.percentile("effect", [0.025, 0.975]).alias("ci"), F.avg("effect").alias("m"), F.stddev_samp("effect").alias("s"), F.count("effect").alias("n")).first()
    placebo = reps.where("kind = 'placebo'").agg(F.avg("effect").alias("m")).first()["m"] or 0.0
    with_ = reps.where("kind = 'full'").agg(F.avg("accuracy_with").alias("a")).first()["a"]
    effect = float(np.median(effects))
    lo, hi = b["ci"] or (0.0, 0.0)
    p = t_two_sided(b["m"] / (b["s"] / b["n"] ** 0.5), b["n"] - 1) if b["n"] and b["n"] > 1 and b["s"] else 1.0
    ratio = abs(placebo) / (abs(effect) + 1e-9) if abs(effect) > 1e-6 else 1.0
    valid = effect > LEAST_EFFECT and lo > 0 and p < P_MOST and ratio < PLACEBO_MOST and sum(e > LEAST_EFFECT for e in effects) >= 2
    score = min(1.0, max(0.0, effect) / 0.20) if valid else 0.0
    return reps.sparkSession.createDataFrame([(effect, float(lo), float(hi), float(p), float(ratio), valid, with_, score)], "causal_effect double, ci_low double, ci_high double, p_value double, placebo_ratio double, proof_valid boolean, accuracy double, suspicion_score double")


def degradation(df: DataFrame) -> DataFrame:
    """days, projected accuracy: what exceeds one half decays by 30 % a month, if proof_valid."""
    out = df.withColumn("days", F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))))
    fall = 0.5 + F.greatest(F.col("accuracy") - 0.5, F.lit(0.0)) * F.pow(F.lit(0.7), F.floor(F.col("days") / 30))
    return out.withColumn("projected", F.when(F.col("proof_valid"), F.round(fall + TIE, 4)).otherwise(F.col("accuracy")))


# ---- fingerprints --------------------------------------------------------------------------------------------------------


def label_and_shift(df: DataFrame, features: list[str], label: str = "label", flagged: str = "flagged") -> DataFrame:
    """label_delta, mean_feature_z and n_shifted (features with z > 2) of flagged against other rows."""
    f = F.col(flagged)
    z = lambda c: F.abs(F.avg(F.when(f, F.col(c))) - F.avg(F.when(~f, F.col(c)))) / (F.stddev_pop(F.when(~f, F.col(c))) + 1e-9)
    out = df.agg(F.abs(F.coalesce(F.avg(F.when(f, F.col(label))), F.lit(0.5)) - F.coalesce(F.avg(F.when(~f, F.col(label))), F.lit(0.5))).alias("label_delta"), F.array(*[z(c) for c in features]).alias("z"))
    return out.select("label_delta", (F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / len(features)).alias("mean_feature_z"), F.size(F.filter("z", lambda x: x > FEATURE_Z)).alias("n_shifted"))


def inertia_ratio(df: DataFrame, features: list[str], flagged: str = "flagged", seed: int = 42) -> DataFrame:
    """n, inertia_ratio: how much two clusters of the flagged rows are tighter than one (0 under six rows)."""
    rows = df.where(flagged).withColumn("_v", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])))
    own = rows.agg(F.count("*").alias("n"), *[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_{i}") for i, c in enumerate(features)]).first()
    ratio = 0.0
    if own["n"] >= 6:
        one = own["n"] * sum(own[f"_{i}"] for i in range(len(features)))
        ratio = one / (KMeans(k=2, seed=seed, featuresCol="_v", maxIter=50).fit(rows).summary.trainingCost + 1e-9)
    return df.sparkSession.createDataFrame([(own["n"], float(ratio))], "n long, inertia_ratio double")


def value_spikes(df: DataFrame, features: list[str], flagged: str = "flagged", top: int | None = 5) -> DataFrame:
    """feature, value (2 digits), flagged_freq, clean_freq, lift: values frequent among flagged rows and rare elsewhere."""
    cells = unpivot(df, features, [flagged]).select(F.col(flagged).alias("f"), "feature", F.round("value", 2).alias("value"))
    n = df.agg(F.count_if(F.col(flagged)).alias("nf"), F.greatest(F.count_if(~F.col(flagged)), F.lit(1)).alias("nc"))
    c = cells.groupBy("feature", "value").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b")).crossJoin(F.broadcast(n))
    c = c.select("feature", "value", (F.col("a") / F.col("nf")).alias("flagged_freq"), (F.col("b") / F.col("nc")).alias("clean_freq")).withColumn("lift", F.when(F.col("clean_freq") > 0, F.col("flagged_freq") / F.col("clean_freq")))
    hit = c.where((F.col("flagged_freq") > 0.05) & ((F.col("clean_freq") < 1e-6) | (F.col("lift") >= SPIKE_LIFT)))
    return hit if top is None else hit.orderBy(F.desc_nulls_first("lift"), F.desc("flagged_freq"), "feature", "value").limit(top)


def block_homogeneity(flagged_rows: DataFrame, features: list[str], rank: str = "row_rank", n: str = "n_rows") -> DataFrame:
    """homogeneity: 1 - mean variance within blocks of a fifth over the total variance (0 under 20 rows).

    ``flagged_rows`` has its own 0-based rank and count; the last, partial block is left out.
    """
    size = F.greatest(F.floor(F.col(n) / 5), F.lit(4))
    mean_var = lambda: sum((F.var_pop(c) for c in features[1:]), F.var_pop(features[0])) / len(features)
    kept = flagged_rows.withColumn("_block", F.floor(F.col(rank) / size)).where(F.col("_block") * size < F.col(n) - size)
    within = kept.groupBy("_block").agg(mean_var().alias("v")).agg(F.avg("v").alias("w"))
    total = flagged_rows.agg(mean_var().alias("t"), F.count("*").alias("c"))
    return within.crossJoin(total).select(F.when((F.col("c") >= 20) & (F.col("t") > 1e-9), 1 - F.col("w") / F.col("t")).otherwise(0.0).alias("homogeneity"))


def fingerprint(m: DataFrame) -> DataFrame:
    """Votes, fingerprint and status from label_delta, mean_feature_z, n_shifted, inertia_ratio, has_spike, homogeneity."""
    votes = {
        "LABEL_FLIP": clip(F.col("label_delta") / LABEL_DELTA * 0.70 + F.greatest(F.lit(0.0), 1 - F.col("mean_feature_z") / 2) * 0.30),
        "BACKDOOR_TRIGGER": F.when(F.col("inertia_ratio") >= TIGHT_RATIO, 0.55).otherwise(0.0) + F.when(F.col("has_spike"), 0.45).otherwise(0.0),
        "GRADIENT_ATTACK": clip(F.least(F.col("n_shifted") / Z_FEATURES, F.lit(1.0)) * 0.60 + F.when(F.col("has_spike"), 0.0).otherwise(0.20) + F.when(F.col("label_delta") < LABEL_DELTA, 0.20).otherwise(0.0)),
        "FEDERATED_BYZANTINE": clip(F.col("homogeneity") / HOMOGENEITY),
    }
    out = m.withColumns({f"vote_{k.lower()}": v for k, v in votes.items()})
    best = F.greatest(*[F.col(f"vote_{k.lower()}") for k in votes])
    kind = F.coalesce(*[F.when(F.col(f"vote_{k.lower()}") == best, k) for k in votes])
    out = out.withColumn("confidence", best)
    status = F.when(F.col("confidence") >= CONFIRMED, "CONFIRMED").when(F.col("confidence") >= SUSPECTED, "SUSPECTED").otherwise("UNDETERMINED")
    return out.withColumn("status", status).withColumn("fingerprint", F.when(F.col("confidence") >= SUSPECTED, kind).otherwise("UNDETERMINED"))


def unsupervised_effect(df: DataFrame, features: list[str], flagged: str = "flagged") -> DataFrame:
    """Variant for tables without labels: mean |difference of means| of flagged and other rows; valid above 0.05."""
    f = F.col(flagged)
    gap = lambda c: F.abs(F.avg(F.when(f, F.col(c))) - F.avg(F.when(~f, F.col(c))))
    out = df.agg((sum((gap(c) for c in features[1:]), gap(features[0])) / len(features)).alias("causal_effect"))
    return out.withColumn("proof_valid", F.col("causal_effect") > 0.05)


