"""Exact positions in a total order, without a window over all rows in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.sources.tables import stored


def with_rank(df: DataFrame, order_by: list[str], name: str = "row_rank", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based position in the order of ``order_by`` (which must be total, for equal results).

    The rows are range partitioned by the whole key, sorted and numbered within their partitions, and written once to
    the shared folder; the sizes of earlier partitions are added. Keys may be of any type that sorts, a constant first
    column costs nothing, and only a row per partition is broadcast. Null comes first. Without ``partitions``, their number
    is the session's.
    """
    placed = df.repartitionByRange(*([partitions] if partitions else []), *order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def with_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def hashed_order(keys: list[str], seed: int) -> Column:
    """A pseudo-random order that depends on the row only."""
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
