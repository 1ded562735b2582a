"""What kind of poisoning it was, how it came in and how far it reaches.

Sample frames have poison_status, and as needed label, batch_id, source_id, client_id, ingested_at and features;
evidence frames have one row per segment with the layers' measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot

# Attack types in the order that settles ties, with severity and subtypes.
ATTACKS = {
    "label_flip": ("medium", ["random_flip", "targeted_flip"]),
    "backdoor": ("critical", ["patch_trigger", "blend_trigger", "wanet"]),
    "clean_label": ("critical", ["feature_collision", "witches_brew"]),
    "gradient_poisoning": ("high", ["gradient_inversion", "scaling"]),
    "boiling_frog": ("high", ["gradual_drift", "slow_injection"]),
}


def is_poisoned(status: str = "poison_status") -> Column:
    return F.coalesce(F.col(status).isin("confirmed", "suspected"), F.lit(False))


def label_entropy(df: DataFrame, label: str = "label", segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Entropy of the non-negative labels in bits."""
    c = df.where(F.col(label) >= 0).groupBy(*segments, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*(segments or [F.lit(0)]))  # a row per class
    p = F.col("n") / F.sum("n").over(w)
    return c.select(*segments, (p * F.log2(p + 1e-10)).alias("t")).groupBy(*segments).agg((-F.sum("t")).alias("label_entropy"))


def classify(evidence: DataFrame) -> DataFrame:
    """Scores, confidence and attack_type from kl, mahalanobis, spectral_gap, backdoor_detected, minority_ratio,
    flagged_ratio, causal_effect, n_quarantined, avg_trust, cumulative_drift, drift_score, label_entropy, n_poisoned."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    backdoor = c("backdoor_detected", False)
    scores = {
        "label_flip": add(c("kl", 0.0) > 1.5, 0.3) + add(c("flagged_ratio", 0.0) > 0.05, 0.2) + add(c("label_entropy", 99.0) < 0.5, 0.3),
        "backdoor": add(backdoor, 0.5) + add(c("spectral_gap", 0.0) > 3.0, 0.3) + add(c("minority_ratio", 1.0) < 0.1, 0.2),
        "clean_label": add((c("mahalanobis", 0.0) > 4.0) & ~backdoor, 0.4) + add((c("causal_effect", 0.0) > 0.08) & ~backdoor, 0.3) + add((c("flagged_ratio", 0.0) > 0.03) & (c("kl", 0.0) < 1.0), 0.2),
        "gradient_poisoning": add(c("n_quarantined", 0) > 0, 0.5) + add(c("avg_trust", 1.0) < 0.4, 0.3) + add((c("mahalanobis", 0.0) > 3.0) & (c("spectral_gap", 0.0) > 2.0), 0.2),
        "boiling_frog": add(c("cumulative_drift", 0.0) > 0.2, 0.4) + add(c("drift_score", 0.0) > 0.1, 0.2) + add(c("n_poisoned", 0) > 5, 0.2),
    }
    out = evidence.withColumns({f"score_{k}": v for k, v in scores.items()})
    total = sum((F.col(f"score_{k}") for k in ATTACKS), F.lit(0.0)) + 1e-8
    best = F.greatest(*[F.col(f"score_{k}") for k in ATTACKS])
    kind = F.coalesce(*[F.when(F.col(f"score_{k}") == best, k) for k in ATTACKS])
    out = out.withColumn("attack_type", kind).withColumn("confidence", F.round(best / total, 4))
    pick = lambda f: F.coalesce(*[F.when(F.col("attack_type") == k, f(v)) for k, v in ATTACKS.items()])
    return out.withColumn("severity", pick(lambda v: F.lit(v[0]))).withColumn("subtypes", pick(lambda v: F.array(*[F.lit(x) for x in v[1]])))


def injection_pattern(samples: DataFrame, segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts, first and last time, numbers of batches, sources, clients, and the schedule of the poisoned rows."""
    p = samples.where(is_poisoned())
    out = p.groupBy(*segments).agg(F.count("*").alias("n_poisoned"), F.min("ingested_at").alias("first_injection"), F.max("ingested_at").alias("last_injection"), F.count_distinct("batch_id").alias("n_batches"), F.count_distinct("source_id").alias("n_sources"), F.count_distinct("client_id").alias("n_clients"))
    return out.withColumn("injection_schedule", F.when(F.col("n_poisoned") == 0, "none").when(F.col("n_poisoned") < 10, "one_shot").when(F.col("n_batches") <= 2, "burst").otherwise("gradual"))


def primary(samples: DataFrame, column: str) -> DataFrame:
    """The most frequent value of ``column`` among poisoned rows; of equal counts the least value."""
    c = samples.where(is_poisoned()).groupBy(column).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), column).limit(1)


def sigma_shift(samples: DataFrame, features: list[str], order_by: list[str]) -> DataFrame:
    """Mean |difference of means| of poisoned and the first equally many clean rows, over the deviation of all their cells."""
    bad = samples.where(is_poisoned())
    n = bad.count()
    good = samples.where(~is_poisoned()).orderBy(*order_by).limit(n)
    a = unpivot(bad, features, []).groupBy("feature").agg(F.avg("value").alias("a"))
    cells = unpivot(good, features, [])
    b = cells.groupBy("feature").agg(F.avg("value").alias("b"))
    s = cells.agg(F.stddev_pop("value").alias("s"))
    shift = a.join(b, "feature").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_shift"))
    return shift.crossJoin(s).select("mean_shift", F.round(F.col("mean_shift") / (F.col("s") + 1e-8), 2).alias("sigma_shift"))


def narrative(df: DataFrame) -> DataFrame:
    """A sentence from attack_type, confidence, n_poisoned, n_batches, injection_schedule, first and last injection."""
    text = F.format_string("%s (confidence %.1f%%): %d poisoned rows in %d batch(es), schedule %s, from %s to %s.", F.initcap(F.replace("attack_type", F.lit("_"), F.lit(" "))), F.col("confidence") * 100, F.col("n_poisoned"), F.col("n_batches"), F.replace("injection_schedule", F.lit("_"), F.lit(" ")), F.date_format("first_injection", "yyyy-MM-dd HH:mm:ss"), F.date_format("last_injection", "yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("narrative", text)


def sophistication(df: DataFrame) -> DataFrame:
    """Score 1..10 and level from n_layers_alarmed, injection_schedule, sigma_shift, severity."""
    evasion = F.round((6 - F.col("n_layers_alarmed")) / 6, 2)
    temporal = F.when(F.col("injection_schedule") == "gradual", 1.0).when(F.col("injection_schedule") == "burst", 0.5).when(F.col("injection_schedule") == "one_shot", 0.2).otherwise(0.3)
    disguise = F.greatest(F.lit(0.0), 1 - F.col("sigma_shift") / 3)
    specific = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "high", 0.7).when(F.col("severity") == "medium", 0.4).otherwise(0.3)
    s = F.round(F.least(F.lit(10.0), F.greatest(F.lit(1.0), evasion * 3 + temporal * 2.5 + disguise * 2.5 + specific * 2)), 1)
    out = df.withColumn("sophistication_score", s)
    return out.withColumn("level", F.when(s >= 8, "APT-grade").when(s >= 4, "Targeted").otherwise("Opportunistic"))


def blast_radius(samples: DataFrame, causal_effect: float | Column) -> DataFrame:
    """Poisoned rows, batches, models, predictions and harm they reach, and the lineage of the first three batches."""
    e = F.abs(F.lit(causal_effect) if isinstance(causal_effect, (int, float)) else causal_effect)
    out = samples.where(is_poisoned()).agg(F.count("*").alias("n_poisoned"), F.count_distinct("batch_id").alias("n_batches"), F.slice(F.array_sort(F.collect_set("batch_id")), 1, 3).alias("first_batches"))
    out = out.withColumn("n_models", F.least(F.col("n_batches") + 1, F.lit(4))).withColumn("prediction_impact_pct", F.round(F.least(e * 150, F.lit(35.0)), 1))
    out = out.withColumn("n_predictions", F.floor(F.col("prediction_impact_pct") / 100 * 10000).cast("long"))
    out = out.withColumn("misjudged", F.floor(F.col("n_predictions") * 0.03).cast("long")).withColumn("cost", F.floor(F.col("n_predictions") * 12.5).cast("long"))
    share = F.round(F.col("prediction_impact_pct") / F.col("n_batches"), 1)
    return out.withColumn("lineage", F.map_from_entries(F.transform("first_batches", lambda b: F.struct(b, share)))).drop("first_batches")


def mark_suspected(rows: DataFrame, score: str = "ensemble_score", status: str = "poison_status") -> DataFrame:
    return rows.withColumn(status, F.when(F.col(score) > 0.6, "suspected").otherwise(F.col(status)))


def no_detection_projection(df: DataFrame) -> DataFrame:
    """days, projected_accuracy, accuracy_loss, harm for 30, 60, 90 days from causal_effect, accuracy, n_predictions; decimal ties go up."""
    out = df.withColumn("days", F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))))
    loss = F.least(F.abs("causal_effect") * (1 + F.col("days") / 30 * 0.3), F.lit(0.25))
    return out.withColumn("projected_accuracy", F.round(F.greatest(F.lit(0.6), F.col("accuracy") - loss) + 1e-9, 4)).withColumn("accuracy_loss", F.round(loss, 4)).withColumn("harm", F.floor(F.col("n_predictions") * (F.col("days") / 30)).cast("long"))


def timeline(samples: DataFrame) -> DataFrame:
    """hour, poison_count, clean_count, cumulative_poison, trust."""
    h = samples.groupBy(F.date_trunc("hour", "ingested_at").alias("hour")).agg(F.count_if(is_poisoned()).alias("poison_count"), F.count_if(~is_poisoned()).alias("clean_count"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # a row per hour
    out = h.withColumn("cumulative_poison", F.sum("poison_count").over(w))
    return out.withColumn("trust", F.round(F.greatest(F.lit(14.0), 82.0 - F.col("cumulative_poison") * 0.8), 1))


def report(results: DataFrame) -> DataFrame:
    """Each result as a JSON document with a hash of it for audits."""
    doc = F.to_json(F.struct(*results.columns))
    return results.withColumn("document", doc).withColumn("audit_hash", F.sha2("document", 256))


def concentration(samples: DataFrame, column: str) -> DataFrame:
    """column, n, flagged_share, lift over the overall share: who contributed the poisoned rows."""
    total = samples.agg(F.avg(is_poisoned().cast("double")).alias("overall"))
    by = samples.groupBy(column).agg(F.count("*").alias("n"), F.avg(is_poisoned().cast("double")).alias("flagged_share"))
    return by.crossJoin(F.broadcast(total)).select(column, "n", "flagged_share", F.when(F.col("overall") > 0, F.col("flagged_share") / F.col("overall")).alias("lift"))
