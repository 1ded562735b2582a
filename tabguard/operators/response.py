"""Actions on verdicts: quarantine, down-weighting, review, and the logs of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.operators.forensics import is_poisoned
from tabguard.operators.ranks import with_rank

# Limits of one round of actions.
MOST_SHARE, WEIGHT, COOLDOWN_SECONDS = 0.05, 0.1, 30
# What to do first for each kind of attack.
PLAYBOOK = [
    ("label_flip", "medium", "Quarantine rows flagged by the shift and ensemble layers; audit where their labels came from."),
    ("backdoor", "critical", "Take the model offline; quarantine the minority activation cluster; block the source of the trigger."),
    ("clean_label", "critical", "Quarantine rows with a Mahalanobis distance above 4; retrain without them and compare."),
    ("gradient_poisoning", "high", "Quarantine clients with trust below 0.3; pause aggregation; roll back to a clean checkpoint."),
    ("boiling_frog", "high", "Freeze the pipeline; compare batch distributions with the oldest clean batch; roll back to it."),
]


def action(score: Column, verdict: Column, observe_only: bool = False) -> Column:
    if observe_only:
        return F.lit("observe")
    return F.when((verdict == "CONFIRMED_POISONED") & (score > 0.7), "quarantine").when((verdict == "SUSPICIOUS") & (score > 0.5), "soft_quarantine").otherwise("monitor")


def cooled_action(decided: Column, seconds_since_last: Column, least: float = COOLDOWN_SECONDS) -> Column:
    """The decided action, or cooldown if the last one was less than ``least`` seconds ago."""
    return F.when(seconds_since_last < least, "cooldown").otherwise(decided)


def _first_share(samples: DataFrame, candidates: DataFrame, order_by: list[str], share: float) -> DataFrame:
    n = samples.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_most"))
    return with_rank(candidates, order_by, "_nth").crossJoin(F.broadcast(n)).where(F.col("_nth") < F.col("_most")).drop("_nth", "_most")


def quarantine(samples: DataFrame, already: DataFrame, order_by: list[str], key: str = "id", share: float = MOST_SHARE) -> DataFrame:
    """Poisoned rows that are not quarantined yet, the first in order, at most this share of all rows (at least one)."""
    return _first_share(samples, samples.where(is_poisoned()).join(already.select(key), key, "left_anti"), order_by, share)


def soft_quarantine(samples: DataFrame, order_by: list[str], key: str = "id", share: float = MOST_SHARE / 2, weight: float = WEIGHT) -> DataFrame:
    """``samples`` with a training weight: lowered for the first poisoned rows, 1 for others."""
    down = _first_share(samples, samples.where(is_poisoned()), order_by, share).select(key, F.lit(weight).alias("_w"))
    return samples.join(down, key, "left").withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_w")


def status(actions: DataFrame) -> DataFrame:
    """Totals of an action log and its last action."""
    return actions.agg(F.count("*").alias("n_actions"), F.coalesce(F.sum("samples_affected"), F.lit(0)).alias("total_affected"), F.max_by("action", F.struct("timestamp", "action_id")).alias("last_action"))


def review_queue(verdicts: DataFrame, now: Column) -> DataFrame:
    """Borderline verdicts as cases, due at the end of the day."""
    s = F.col("overall_suspicion")
    return verdicts.where((s >= 0.35) & (s < 0.65)).withColumn("status", F.lit("pending")).withColumn("created_at", now).withColumn("deadline", F.date_trunc("day", now) + F.expr("INTERVAL 23 HOURS 59 MINUTES"))


def pending(cases: DataFrame, decisions: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.join(decisions.select(key), key, "left_anti")


def incidents(actions: DataFrame, decisions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest actions and decisions with a severity."""
    a = actions.select(F.lit("auto_defense").alias("type"), "action", F.col("action_id").cast("string").alias("ref"), "timestamp", F.when(F.col("action") == "quarantine", "high").otherwise("medium").alias("severity"))
    d = decisions.select(F.lit("human_decision").alias("type"), F.col("decision").alias("action"), F.col("case_id").cast("string").alias("ref"), F.col("decided_at").alias("timestamp"), F.lit("info").alias("severity"))
    return a.unionByName(d).orderBy(F.desc("timestamp"), "type", "ref").limit(limit)


def resilience(tests: DataFrame) -> DataFrame:
    """Tests, caught, catch rate, mean time and mean score per attack type, and over all (null type)."""
    out = tests.rollup("attack_type").agg(F.count("*").alias("total_tests"), F.count_if("detected").alias("caught"), F.avg("detection_ms").alias("avg_detection_ms"), F.avg("score").alias("avg_score"))
    return out.select("attack_type", "total_tests", "caught", F.round(F.col("caught") / F.col("total_tests") * 100, 1).alias("catch_rate_pct"), F.round("avg_detection_ms", 1).alias("avg_detection_ms"), F.round("avg_score", 4).alias("avg_score"))


def with_playbook(df: DataFrame) -> DataFrame:
    """``df`` with the first steps for its attack_type."""
    book = df.sparkSession.createDataFrame(PLAYBOOK, "attack_type string, playbook_severity string, immediate_steps string")
    return df.join(F.broadcast(book), "attack_type", "left")
