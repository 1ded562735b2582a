"""Positions of regular-expression matches, with built-in functions only.

Spark has no function for the positions of matches, but the text between matches has known lengths: ``split`` by the
same pattern gives those gaps, and the running sum of gaps and matches gives code-point positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def found(text: Column, pattern: str, before: Callable[[Column], Column] | None = None, after: Callable[[Column], Column] | None = None) -> Column:
    """Array of (value, gap, before, after): the matches of ``pattern``, leftmost and not overlapping.

    gap: code points between the match and the one before it (or the start); before and after: what the functions
    make of the text in front of the match and behind it, up to the next match on either side. Null if nothing matches,
    so the second pass over the text is made only where something does.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    plain = lambda f: F.transform(gaps, f) if f else F.array().cast("array<string>")

    sides = F.struct(F.transform(gaps, F.length).alias("size"), plain(before).alias("before"), plain(after).alias("after"))
    made = F.transform(F.array(sides), lambda g: F.transform(values, lambda value, i: F.struct(value.alias("value"), F.get(g["size"], i).alias("gap"), F.get(g["before"], i).alias("before"), F.get(g["after"], i + 1).alias("after"))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.get(made, F.lit(0)))


def placed(matches: DataFrame, keys: list[str], array: str) -> DataFrame:
    """One row per match with ``start`` and ``end`` (exclusive) in code points; ``matches`` has one row per keys."""
    m = matches.where(F.col(array).isNotNull()).select(*keys, F.posexplode(array).alias("nth", "m"))
    w = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(w)
    return m.select(*keys, F.col("m.value").alias("value"), F.col("m.before").alias("before"), F.col("m.after").alias("after"), end.alias("end")).withColumn("start", F.col("end") - F.length("value"))


def joined(array: Column) -> Column:
    """kind:start:end of each struct in an array, comma-joined; empty for null."""
    return F.coalesce(F.concat_ws(",", F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))), F.lit(""))
