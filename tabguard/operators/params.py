"""Tables of learned parameters: one row per unit of a model, with its parameters as an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.operators.ranks import hashed_order


def padded(df: DataFrame, params: str = "params") -> DataFrame:
    """All arrays as long as the model's longest, filled with 0."""
    longest = df.groupBy("model_id").agg(F.max(F.size(params)).alias("_n"))
    return df.join(longest, "model_id").withColumn(params, F.concat(F.col(params), F.array_repeat(F.lit(0.0), F.col("_n") - F.size(params)))).drop("_n")


def finite(df: DataFrame, params: str = "params") -> DataFrame:
    """NaN and null as 0, infinities as plus or minus a million."""
    return df.withColumn(params, F.transform(params, lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).when(x == float("inf"), 1e6).when(x == float("-inf"), -1e6).otherwise(x)))


def unit_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n units picked by hash; only where a caller asks for a sample."""
    return df.orderBy(hashed_order(["model_id", "unit_id"], seed), "model_id", "unit_id").limit(n)


def statistics(df: DataFrame, params: str = "params") -> DataFrame:
    """model_id, n, mean, sigma (population), min, max and sparsity (share under 1e-6 in size) of all parameters."""
    x = df.select("model_id", F.explode(params).alias("x"))
    return x.groupBy("model_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sigma"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg((F.abs("x") < 1e-6).cast("double")).alias("sparsity"))


def wide(df: DataFrame, n: int, params: str = "params", units_per_batch: int = 50) -> DataFrame:
    """p0 .. p(n-1) as columns, with batch_id, ready for the layers (no labels)."""
    return df.select("model_id", "unit_id", F.floor(F.col("unit_id") / units_per_batch).alias("batch_id"), *[F.coalesce(F.get(params, F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(n)])
