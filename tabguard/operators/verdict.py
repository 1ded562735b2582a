"""Fusion of the layers' scores into a verdict per segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.numeric import clip

# Layer weights and verdict thresholds.
WEIGHTS = {"l1": 0.35, "l2": 0.20, "l3": 0.20, "l4": 0.20, "l5": 0.05}
CONFIRMED, SUSPICIOUS, LOW_RISK = 0.65, 0.35, 0.15
V1_LABELLED = [0.20, 0.20, 0.20, 0.25, 0.10, 0.05]
V1_UNLABELLED = [0.30, 0.15, 0.30, 0.10, 0.10, 0.05]


def gated_ensemble(score: Column, flagged_ratio: Column, expected: float = 0.05, excess: float = 0.02) -> Column:
    """The ensemble's score counts in full only if clearly more rows than expected are flagged."""
    return F.when(flagged_ratio - expected > excess, score).otherwise(score * 0.2)


def overall_score(df: DataFrame) -> DataFrame:
    """``df`` (l1, l2, l3, l4, l5, flagged_ratio) with overall_suspicion."""
    parts = {**{k: F.col(k) for k in WEIGHTS}, "l3": gated_ensemble(F.col("l3"), F.col("flagged_ratio"))}
    return df.withColumn("overall_suspicion", clip(reduce(lambda a, b: a + b, [WEIGHTS[k] * F.coalesce(parts[k], F.lit(0.0)) for k in WEIGHTS])))


def with_verdict(df: DataFrame) -> DataFrame:
    """Needs overall_suspicion, proof_valid, blend_alarm, spectral_alarm."""
    s = F.col("overall_suspicion")
    proof = F.coalesce(F.col("proof_valid"), F.lit(False)) | (F.coalesce(F.col("blend_alarm"), F.lit(False)) & F.coalesce(F.col("spectral_alarm"), F.lit(False)))
    v = F.when((s >= CONFIRMED) & proof, "CONFIRMED_POISONED").when(s >= SUSPICIOUS, "SUSPICIOUS").when(s >= LOW_RISK, "LOW_RISK").otherwise("CLEAN")
    return df.withColumn("verdict", v)


def layers_alarmed(df: DataFrame) -> DataFrame:
    """n_layers_alarmed from l1_alarm, spectral_alarm, flagged_ratio, proof_valid, n_quarantined."""
    flags = [F.col("l1_alarm"), F.col("spectral_alarm"), F.col("flagged_ratio") > 0.08, F.col("proof_valid"), F.col("n_quarantined") > 0]
    return df.withColumn("n_layers_alarmed", reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags]))


def needs_review(score: Column) -> Column:
    return (score >= 0.35) & (score < 0.65)


def fusion_v1(df: DataFrame, labelled: bool = True) -> DataFrame:
    """Variant: six weights over l1..l5 and drift, four levels."""
    w = V1_LABELLED if labelled else V1_UNLABELLED
    s = F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, [x * F.col(c) for x, c in zip(w, ["l1", "l2", "l3", "l4", "l5", "drift"], strict=True)])), 4)
    df = df.withColumn("overall_suspicion", s)
    v = F.when(s >= 0.70, "CONFIRMED_POISONED").when(s >= 0.50, "SUSPICIOUS").when(s >= 0.30, "LOW_RISK").otherwise("CLEAN")
    level = F.when(s >= 0.70, "CRITICAL").when(s >= 0.50, "MODERATE").when(s >= 0.30, "LOW").otherwise("NONE")
    return df.withColumn("verdict", v).withColumn("poisoning_level", level)


def trust_grade(df: DataFrame, score: str = "overall_suspicion") -> DataFrame:
    """poison_risk, data_quality, behavioral_trust, overall, grade, backdoor_risk, robustness, stability."""
    s, zero = F.col(score), F.lit(0.0)
    df = df.withColumn("poison_risk", F.round(s * 100, 1))
    df = df.withColumn("data_quality", F.round(F.greatest(zero, 100 - F.col("poison_risk") * 1.2), 1)).withColumn("behavioral_trust", F.round(F.greatest(zero, 100 - F.col("poison_risk") * 0.8), 1))
    df = df.withColumn("overall", F.round(F.col("data_quality") * 0.4 + (100 - F.col("poison_risk")) * 0.35 + F.col("behavioral_trust") * 0.25, 1))
    o = F.col("overall")
    grade = F.when(o < 40, "F").when(o < 55, "D").when(o < 70, "C").when(o < 85, "B").otherwise("A")
    return df.withColumn("grade", grade).withColumn("backdoor_risk", F.when(s > 0.7, "HIGH").when(s > 0.4, "MEDIUM").otherwise("LOW")).withColumn("robustness", F.when(s > 0.7, "LOW").when(s > 0.4, "MEDIUM").otherwise("HIGH")).withColumn("stability", F.round(F.greatest(F.lit(70.0), 100 - s * 30), 1))


def threat_level(score: Column) -> Column:
    return F.when(score > 0.65, "CRITICAL").when(score > 0.35, "ELEVATED").when(score > 0.15, "GUARDED").otherwise("NOMINAL")
