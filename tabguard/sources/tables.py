"""Reading inputs and keeping results as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; where none is set, a local master gets a temporary one, and a cluster an error."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own = _own or tempfile.mkdtemp(prefix="spark-shared-")
        base = _own
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV files with a header; types by ``schema``, or inferred in a pass of its own."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)


def row_cap(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first n rows; only where a caller asks for a cap."""
    return df.orderBy(*order_by).limit(n)


def parameter_table(df: DataFrame) -> DataFrame:
    """(model_id, unit_id, params array<double>) of exported model parameters."""
    return df.select("model_id", "unit_id", F.col("params").cast("array<double>").alias("params"))


def client_gradients(df: DataFrame) -> DataFrame:
    """(client_id, round, gradient array<double>, n_samples); one sample where the count is missing."""
    n = F.coalesce(F.col("n_samples"), F.lit(1)).cast("int") if "n_samples" in df.columns else F.lit(1)
    return df.select("client_id", "round", F.col("gradient").cast("array<double>").alias("gradient"), n.alias("n_samples"))


def as_document(df: DataFrame, name: str = "full_json") -> DataFrame:
    """``df`` with all its columns as one JSON text."""
    return df.withColumn(name, F.to_json(F.struct(*df.columns)))


def save_results(df: DataFrame, path: str) -> None:
    """Append results, in folders by source; a row with an id that is there already replaces it when read."""
    df.write.mode("append").partitionBy("source").parquet(path)


def latest(df: DataFrame, key: str = "id", by: str = "created_at") -> DataFrame:
    """The newest row of each id."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def store_and_read_latest(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "results")
    save_results(df, path)
    return latest(df.sparkSession.read.parquet(path))
