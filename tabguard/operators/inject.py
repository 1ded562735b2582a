"""Poison injection as a transform: labelled tables for evaluating the detectors.

The changed rows are the first in a pseudo-random order of their keys, so the same rows change on any partitioning.
Every function returns the table with poison_status and attack_type set on the changed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.operators.ranks import hashed_order


def _start(df: DataFrame) -> DataFrame:
    out = df if "poison_status" in df.columns else df.withColumn("poison_status", F.lit("clean"))
    return out if "attack_type" in out.columns else out.withColumn("attack_type", F.lit(None).cast("string"))


def _chosen(df: DataFrame, keys: list[str], n: int, who: Column, order: Column | None, seed: int) -> DataFrame:
    """``df`` with _nth, the 0-based place among the n chosen rows (null for others).

    Only the n smallest hashes are sorted; they come to each row by a join on its keys.
    """
    o = hashed_order(keys, seed) if order is None else order
    first = df.where(who).select(*keys, o.alias("_o")).orderBy("_o", *keys).limit(n)
    numbered = first.withColumn("_nth", F.row_number().over(Window.orderBy("_o", *keys)) - 1).drop("_o")  # n rows
    return df.join(numbered, keys, "left")


def _mark(df: DataFrame, attack: str, changes: dict[str, Column]) -> DataFrame:
    hit = F.col("_nth").isNotNull()
    out = df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
    return out.withColumns({"poison_status": F.when(hit, "confirmed").otherwise(F.col("poison_status")), "attack_type": F.when(hit, attack).otherwise(F.col("attack_type"))}).drop("_nth")


def label_flip(df: DataFrame, keys: list[str], n: int = 30, label: str = "label", order: Column | None = None, seed: int = 1) -> DataFrame:
    """The label of n rows from 1 to 0."""
    df = _start(df)
    return _mark(_chosen(df, keys, n, F.col(label) == 1, order, seed), "label_flip", {label: F.lit(0)})


def random_flip(df: DataFrame, keys: list[str], rate: float, classes: list, label: str = "label", seed: int = 2) -> DataFrame:
    """A share of rows to another class, picked by hash."""
    df = _start(df)
    hit = F.pmod(hashed_order(keys, seed), F.lit(1_000_000)) < int(rate * 1_000_000)
    others = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c != F.col(label))
    wrong = F.get(others, F.pmod(hashed_order(keys, seed + 1), F.size(others)).cast("int"))
    return _mark(df.withColumn("_nth", F.when(hit, 0)), "label_flip", {label: wrong})


def feature_noise(df: DataFrame, keys: list[str], features: list[str], rate: float, seed: int = 3) -> DataFrame:
    """One feature of a share of rows at mean + U(8, 15) sigma."""
    df = _start(df)
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in features])
    hit = F.pmod(hashed_order(keys, seed), F.lit(1_000_000)) < int(rate * 1_000_000)
    which = F.pmod(hashed_order(keys, seed + 1), F.lit(len(features)))
    u = 8 + 7 * F.pmod(hashed_order(keys, seed + 2), F.lit(1_000_000)) / 1_000_000
    out = df.crossJoin(F.broadcast(stats)).withColumn("_nth", F.when(hit, 0))
    changes = {c: F.when(which == i, F.col(f"_{c}.m") + u * F.col(f"_{c}.s")).otherwise(F.col(c)) for i, c in enumerate(features)}
    return _mark(out, "feature_noise", changes).drop(*[f"_{c}" for c in features])


def patch_trigger(df: DataFrame, keys: list[str], add: dict[str, float], n: int = 25, label: str = "label", order: Column | None = None, seed: int = 4) -> DataFrame:
    """Constants added to some features of n clean rows with label 0, which get label 1."""
    df = _start(df)
    return _mark(_chosen(df, keys, n, (F.col(label) == 0) & (F.col("poison_status") == "clean"), order, seed), "backdoor", {**{c: F.col(c) + x for c, x in add.items()}, label: F.lit(1)})


def extreme_trigger(df: DataFrame, keys: list[str], feature: str, target: int, n: int = 25, label: str = "label", order: Column | None = None, seed: int = 5) -> DataFrame:
    """A feature of n rows at ten times its largest value, and the target label."""
    df = _start(df)
    top = df.agg(F.max(feature).alias("_top"))
    out = _chosen(df, keys, n, F.lit(True), order, seed).crossJoin(F.broadcast(top))
    return _mark(out, "backdoor", {feature: F.col("_top") * 10, label: F.lit(target)}).drop("_top")


def _normal(keys: list[str], seed: int) -> Column:
    """A standard normal number from the row's key (Box-Muller)."""
    u = lambda s: (F.pmod(hashed_order(keys, s), F.lit(1_000_003)) + 0.5) / 1_000_003
    return F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * 3.141592653589793 * u(seed + 1000))


def slow_drift(df: DataFrame, keys: list[str], features: list[str], n: int = 40, reach: float = 0.08, order: Column | None = None, seed: int = 6) -> DataFrame:
    """Noise on n clean rows whose deviation grows with their place; never below 0."""
    df = _start(df)
    out = _chosen(df, keys, n, F.col("poison_status") == "clean", order, seed)
    return _mark(out, "boiling_frog", {c: F.greatest(F.lit(0.0), F.col(c) + F.col("_nth") / n * reach * _normal(keys, seed + 10 + i)) for i, c in enumerate(features)})


def _towards(df: DataFrame, features: list[str], label: str, target: int) -> tuple[DataFrame, dict[str, Column]]:
    """The centroid of a class next to each row, and each row's unit direction to it."""
    centre = df.where(F.col(label) == target).agg(*[F.avg(c).alias(f"_{c}") for c in features])
    out = df.crossJoin(F.broadcast(centre))
    gap = {c: F.col(f"_{c}") - F.col(c) for c in features}
    norm = F.sqrt(sum((g * g for g in gap.values()), F.lit(0.0))) + 1e-8
    return out, {c: g / norm for c, g in gap.items()}


def clean_label(df: DataFrame, keys: list[str], features: list[str], n: int = 20, label: str = "label", order: Column | None = None, seed: int = 7) -> DataFrame:
    """n clean rows of label 0 moved a little towards the centroid of label 1; labels stay."""
    df, way = _towards(_start(df), features, label, 1)
    out = _chosen(df, keys, n, (F.col(label) == 0) & (F.col("poison_status") == "clean"), order, seed)
    step = 0.08 + F.col("_nth") / n * 0.04
    return _mark(out, "clean_label", {c: F.greatest(F.lit(0.0), F.col(c) + step * way[c]) for c in features}).drop(*[f"_{c}" for c in features])


def gradient_poisoning(df: DataFrame, keys: list[str], features: list[str], overwrite: dict[str, float], n: int = 15, label: str = "label", order: Column | None = None, seed: int = 8) -> DataFrame:
    """n clean rows of label 1 moved towards the centroid of label 0; the features in ``overwrite`` are drawn around it."""
    df, way = _towards(_start(df), features, label, 0)
    out = _chosen(df, keys, n, (F.col(label) == 1) & (F.col("poison_status") == "clean"), order, seed)
    step = 0.15 + F.col("_nth") / n * 0.10
    moved = {c: F.col(f"_{c}") + overwrite[c] * _normal(keys, seed + 20 + i) if c in overwrite else F.col(c) + step * way[c] for i, c in enumerate(features)}
    return _mark(out, "gradient_poisoning", {c: F.greatest(F.lit(0.0), v) for c, v in moved.items()}).drop(*[f"_{c}" for c in features])


def detection_quality(rows: DataFrame, flagged: str = "flagged", by: str = "attack_type") -> DataFrame:
    """Per attack: poisoned rows, caught, recall; precision and false-positive rate over the whole table; detected."""
    bad = F.col("poison_status").isin("confirmed", "suspected")
    t = rows.agg(F.count_if(F.col(flagged)).alias("_f"), F.count_if(F.col(flagged) & bad).alias("_tp"), F.count_if(F.col(flagged) & ~bad).alias("_fp"), F.count_if(~bad).alias("_neg"))
    g = rows.where(bad).groupBy(by).agg(F.count("*").alias("n_poisoned"), F.count_if(F.col(flagged)).alias("caught"))
    return g.crossJoin(F.broadcast(t)).select(by, "n_poisoned", "caught", (F.col("caught") / F.col("n_poisoned")).alias("recall"), F.when(F.col("_f") > 0, F.col("_tp") / F.col("_f")).alias("precision"), (F.col("_fp") / F.col("_neg")).alias("false_positive_rate"), (F.col("caught") > 0).alias("detected"))


def summary(rows: DataFrame) -> DataFrame:
    bad = F.col("poison_status").isin("confirmed", "suspected")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_poisoned"), F.avg(bad.cast("double")).alias("poison_rate"))
