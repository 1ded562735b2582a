"""Queries over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(results: DataFrame, scans: DataFrame, result_id: str) -> DataFrame:
    """The result with this id; a model scan if there is none."""
    both = results.withColumn("kind", F.lit(0)).unionByName(scans.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.where(F.col("id") == result_id).orderBy("kind").limit(1)


def latest(results: DataFrame, source: str | None = None) -> DataFrame:
    rows = results if source is None else results.where(F.col("source") == source)
    row = F.struct(*results.columns)
    return rows.agg(F.max_by(row, F.struct("created_at", "id")).alias("r")).where("r IS NOT NULL").select("r.*")


def history(results: DataFrame, limit: int = 20) -> DataFrame:
    return results.orderBy(F.desc("created_at"), "id").limit(limit)


def merged_history(results: DataFrame, scans: DataFrame, limit: int = 20) -> DataFrame:
    return history(results.unionByName(scans, allowMissingColumns=True), limit)


def totals(results: DataFrame) -> DataFrame:
    """n by source, and by verdict, in one pass."""
    return results.groupingSets([["source"], ["verdict"]], "source", "verdict").agg(F.count("*").alias("n"))


def listing(samples: DataFrame, status: str | None, order_by: list[str], limit: int, offset: int = 0) -> DataFrame:
    rows = samples if status is None else samples.where(F.col("poison_status") == status)
    return rows.orderBy(*order_by).offset(offset).limit(limit)


def restricted(samples: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return samples.join(ids.select(key), key, "left_semi")


def best(results: DataFrame, prefer: list[str] = ["upload", "demo", "store"]) -> DataFrame:  # noqa: B006
    """The newest result of the most preferred source that has any."""
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(prefer)], F.lit(len(prefer)))
    return results.withColumn("_r", rank).orderBy("_r", F.desc("created_at"), "id").limit(1).drop("_r")
