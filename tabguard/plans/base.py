"""Registration of queries with their oracle SQL, and the feature table that most of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that DuckDB checks it by."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features, label (returned or not), order key and segment column of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*ORDER, "l_suppkey", *FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("label"))


#: The same table in SQL, scaled to [0, 1], ranked and split, and unpivoted; oracles build on these names.
LI = """li AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""
_SCALE = ", ".join(f"({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END AS {c}" for c in FEATURES)
SPLIT = f"""{LI}, ranked AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, label, {_SCALE},
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS row_rank, count(*) OVER () AS n_rows FROM li),
split AS (SELECT *, CASE WHEN row_rank < floor(0.7 * n_rows) THEN 'reference' ELSE 'incoming' END AS split FROM ranked)"""
LONG = f"""{SPLIT}, long AS (SELECT split, row_rank, label, feature, value FROM split UNPIVOT (value FOR feature IN ({", ".join(FEATURES)})))"""
