"""Connected components of edges between rows, by turns of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.sources.tables import stored


def components(edges: DataFrame, most_turns: int = 100) -> DataFrame:
    """key, component (its least key) of every end of an edge (a, b).

    Every turn links a node's larger neighbours, then its smaller ones, to the least node known to it, so paths shrink by
    about half and edges do not grow in number. Each turn is written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_turns):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.where("a <> b"), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = stored(small.where("a <> b").distinct(), "edges")
        settled = new.exceptAll(e).limit(1).count() == 0 and e.exceptAll(new).limit(1).count() == 0
        e = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("key"), F.col("b").alias("component")).union(e.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())
