"""Streaming forms of the measurements that can be kept up row by row.

``run`` drives a streaming frame over what its source holds now and returns what was written; a service would start
the same frames without the trigger. Checkpoints and sinks lie in the cluster's shared folder. Keyed state is in ``keyed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators import drift as D
from tabguard.sources.tables import scratch


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files at ``path`` (a folder or a pattern)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drive(df: DataFrame, to: str, state: str, mode: str = "append") -> None:
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(to).awaitTermination()


def run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything ``df`` gives now, written once and read back."""
    spark = df.sparkSession
    to = scratch(spark, name)
    _drive(df, to, scratch(spark, f"{name}-state"), mode)
    return spark.read.schema(df.schema).parquet(to)


# ---- windows, scoring, events (S2, S3, S4, S6) ------------------------------------------------------------------------------


def _partials(rows: DataFrame, name: str, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``part`` of every micro-batch, in one table; a repeated micro-batch replaces what it wrote."""
    to = scratch(rows.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{to}/part={number}")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", scratch(rows.sparkSession, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(to).drop("part")


def hourly_counts(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, poison_count, clean_count of event-time hours, each given once, when the watermark has passed its end.

    A row counts if its hour is still open when it comes, that is as long as no row ``late`` newer than the hour's end has
    come in an earlier micro-batch; later ones are left out.
    """
    bad = F.col("poison_status").isin("confirmed", "suspected")
    hours = samples.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 hour").alias("w"))
    return hours.agg(F.count_if(bad).alias("poison_count"), F.count_if(~bad).alias("clean_count")).select(F.col("w.start").alias("hour"), "poison_count", "clean_count")


def drift_per_batch(shares: DataFrame, features: list[str], batch: str = "batch") -> DataFrame:
    """Snapshots of every micro-batch go to a table; those of one batch are merged, and drift is taken over all at the end."""
    parts = _partials(shares, "snapshots", lambda df: D.snapshots(df, features, batch))
    return D.drift(D.merged(parts, batch), batch)


def event_feed(verdicts: DataFrame) -> DataFrame:
    """id, event for each verdict row: analysed, and by its verdict confirmed, defended, to be reviewed."""
    s = F.col("overall_suspicion")
    bad = F.col("verdict") == "CONFIRMED_POISONED"
    events = F.array(F.lit("sample_analyzed"), F.when(bad, "attack_confirmed"), F.when(bad & (s > 0.7), "defense_triggered"), F.when((s >= 0.35) & (s < 0.65), "human_review_required"))
    return verdicts.select("id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("event"))


