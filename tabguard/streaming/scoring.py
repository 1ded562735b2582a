"""Scoring a stream, window by window, against a baseline that was fitted once and stored.

The baseline has, for each feature, the reference's location and scale, the counts of its histogram, and its distribution
function at a grid of its own quantiles; and one row with the distances from the centre that bound the boundary and the tail.
A micro-batch adds to counts by (window, feature, bin, place in the grid), which merge with those of other micro-batches
whatever rows came with which. From the merged counts come divergence, transport distance, tail score and shares per window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import ensemble, quantiles, shift
from tabguard.streaming.stream import _partials

#: Quantiles of the reference between which distribution functions are compared.
GRID = [i / 20 for i in range(21)]
#: Values this near to a grid point count as equal to it.
TIE = 1e-9
#: Added to counts of bins, and the least and greatest share below a value.
SMOOTH, LEAST_SHARE = 1e-10, 1e-9


@dataclass
class Baseline:
    """facts: a row per feature; pattern: one row."""

    facts: DataFrame
    pattern: DataFrame
    features: list[str]

    def save(self, path: str) -> None:
        self.facts.write.mode("overwrite").parquet(f"{path}/facts")
        self.pattern.write.mode("overwrite").parquet(f"{path}/pattern")

    @staticmethod
    def load(spark: SparkSession, path: str, features: list[str]) -> Baseline:
        return Baseline(spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/pattern"), features)


def _below(value: Column, grid: Column) -> Column:
    """How many grid points lie below the value: its place, 0 up to the first point and the size of the grid beyond the last."""
    return F.size(F.filter(grid, lambda c: value > c + TIE))


def fit(reference: DataFrame, features: list[str], bins: int = shift.BINS) -> Baseline:
    """The baseline of a table; one pass for each of its parts, none over the values of a feature in one task."""
    long = unpivot(reference, features, []).withColumn("split", F.lit("reference"))
    base = shift.baseline(long)
    grid = quantiles.percentiles(long, ["feature"], "value", GRID).select("feature", F.col("q").alias("grid"))
    placed = long.where("value IS NOT NULL").join(F.broadcast(grid), "feature").groupBy("feature", _below(F.col("value"), F.col("grid")).alias("place")).agg(F.count("*").alias("n"))
    places = placed.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("places"))  # a count per grid point
    held = shift.histogram(long, base, bins=bins).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    facts = base.join(grid, "feature").join(places, "feature").join(held, "feature", "left")
    pattern = ensemble.pattern_reference(reference, features, F.lit(True))
    return Baseline(facts, pattern, features)


def counts(rows: DataFrame, base: Baseline, at: str, width: str, bins: int = shift.BINS) -> DataFrame:
    """w, feature, bin (null out of range), place, n of some rows; feature is null for rows by their place from the centre."""
    timed = rows.withColumn("w", F.window(at, width)["start"])
    facts = F.broadcast(base.facts.select("feature", "p1", "p99", "grid"))
    cells = unpivot(timed, base.features, ["w"]).where("value IS NOT NULL").join(facts, "feature")
    values = cells.select("w", "feature", shift.bin_of(F.col("value"), F.col("p1"), F.col("p99"), bins).alias("bin"), _below(F.col("value"), F.col("grid")).alias("place"))
    far = ensemble.centre_distance(timed, base.pattern, base.features)
    where = F.when(F.col("distance") < F.col("p25"), 0).when(F.col("distance") > F.col("p80"), 2).otherwise(1)
    rows_of = far.select("w", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("bin"), where.alias("place"))
    return values.unionByName(rows_of).groupBy("w", "feature", "bin", "place").agg(F.count("*").alias("n"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def by_feature(merged: DataFrame, base: Baseline, bins: int = shift.BINS) -> DataFrame:
    """w, feature, n, kl, w1, w1_norm, tail, out_of_range of every window.

    kl is that of the histograms over the reference's range, w1 the area between both distribution functions at the grid,
    tail the mean of -ln min(F, 1 - F) with F the reference's share up to the value's place in the grid.
    """
    own = merged.where("feature IS NOT NULL")
    held = own.where("bin IS NOT NULL").groupBy("w", "feature", "bin").agg(F.sum("n").alias("n")).groupBy("w", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("mine"))
    placed = own.groupBy("w", "feature", "place").agg(F.sum("n").alias("n")).groupBy("w", "feature").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("at"))
    both = placed.join(held, ["w", "feature"], "left").join(F.broadcast(base.facts), "feature")
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    count = lambda m: F.transform(every, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)) + SMOOTH)
    both = both.withColumns({"_p": count(F.col("mine")), "_q": count(F.col("held"))}).withColumns({"_p": F.transform("_p", lambda x: x / _sum(F.col("_p"))), "_q": F.transform("_q", lambda x: x / _sum(F.col("_q")))})
    both = both.withColumn("kl", F.when(F.col("p99") > F.col("p1"), _sum(F.zip_with("_p", "_q", lambda p, q: p * F.log(p / q)))).otherwise(0.0))
    points = F.sequence(F.lit(0), F.lit(len(GRID) - 1))
    upto = lambda m, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda s, j: s + F.coalesce(F.try_element_at(m, j), F.lit(0)))
    both = both.withColumns({"_f": F.transform(points, lambda i: upto(F.col("at"), i) / F.col("total")), "_g": F.transform(points, lambda i: upto(F.col("places"), i) / F.col("n"))})
    gap = F.transform(F.sequence(F.lit(0), F.lit(len(GRID) - 2)), lambda i: F.abs(F.get("_f", i) - F.get("_g", i)) * (F.get("grid", i + 1) - F.get("grid", i)))
    share = lambda i: F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(1 - LEAST_SHARE), F.coalesce(F.get("_g", i), F.lit(1.0))))
    tails = F.transform(F.map_entries("at"), lambda e: e["value"] * -F.log(F.least(share(e["key"]), 1 - share(e["key"]))))
    inside = F.coalesce(F.aggregate(F.map_values("mine"), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    return both.select("w", "feature", F.col("total").alias("n"), "kl", _sum(gap).alias("w1"), (_sum(gap) / F.col("iqr")).alias("w1_norm"), (_sum(tails) / F.col("total")).alias("tail"), (1 - inside / F.col("total")).alias("out_of_range"))


def by_row(merged: DataFrame) -> DataFrame:
    """w, n, boundary, tail: shares of the window's rows nearer and farther than the reference's bounds."""
    own = merged.where("feature IS NULL").groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("place") == 0, F.col("n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("place") == 2, F.col("n")).otherwise(0)).alias("_b"))
    return own.select("w", "n", (F.col("_a") / F.col("n")).alias("boundary"), (F.col("_b") / F.col("n")).alias("tail"))


def scored(rows: DataFrame, base: Baseline, at: str, width: str) -> DataFrame:
    """The merged counts of a stream, for ``by_feature`` and ``by_row``."""
    parts = _partials(rows, "scored", lambda batch: counts(batch, base, at, width))
    return parts.groupBy("w", "feature", "bin", "place").agg(F.sum("n").alias("n"))
