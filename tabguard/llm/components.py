"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; the root is the least node of its component.

    Each turn links every node to the least node around it, first from the side of larger neighbours, then of smaller
    ones, until nothing changes. No node's neighbours are gathered, and a hub is read by several tasks where adaptive
    execution splits it; turns grow with the logarithm of the diameter.
    An edge with a null end adds nothing; an empty table gives an empty result.
    """
    # The larger end always comes first.
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    e = stored(e, "edges")
    sign = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        dropped(old)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
