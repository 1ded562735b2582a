"""Exact quantiles by distributed selection.

An order statistic is found by narrowing a range of values: a pass counts the rows of each bucket of the range, with each
bucket's own least and greatest value, and goes on in the bucket that holds the wanted position. As ranges shrink to
values that occur, repeated values end at once, and far outliers cost a pass and no more. All groups and quantiles narrow
together. When a range holds at most ``REST`` rows they are sorted as one list. So no task ever holds the values of a group
beyond that bound, and what moves in a pass is at most BUCKETS counts a range and task.

Null and NaN values are left out, infinite ones count as the largest finite numbers. Between two order statistics the
quantile is interpolated, as ``percentile`` does; between equal ones it is their value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.sources.tables import stored

#: Buckets of a range, rows of a range that are sorted as one list, ranges that are broadcast (a row of a few numbers each).
BUCKETS, REST, SMALL = 1024, 1 << 15, 1 << 16
_MOST = 1.7976931348623157e308


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Rising with the value; halves keep the width of the widest range finite."""
    return F.least(F.lit(buckets - 1), F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)).cast("int")


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], rest: int = REST, buckets: int = BUCKETS) -> DataFrame:
    """``keys``, n and q: the quantiles ``at`` of each group, null where it has no values."""
    mine = [f"_k{i}" for i in range(len(keys))]
    c = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], c.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumns({"_v": F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.col("_v"))), "_all": F.lit(0)})
    mine = [*mine, "_all"]  # so that there is always a key
    groups = stored(rows.groupBy(*mine).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-groups")
    # A quantile lies between two positions of the sorted values.
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(a)) * (F.col("_n") - 1)).alias("at")) for i, a in enumerate(at)])
    asked = groups.select(*mine, "_n", F.explode(wanted).alias("_w")).select(*mine, "_n", F.col("_w.i").alias("_i"), F.col("_w.at").alias("_at"))
    positions = asked.select(*mine, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_pos")).distinct()
    open_ = positions.join(groups, mine).select(*mine, "_pos", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_left"))

    def ranges_of(t: DataFrame) -> DataFrame:
        r = stored(t.select(*mine, "_lo", "_hi").distinct(), "quantile-ranges")
        return F.broadcast(r) if r.count() <= SMALL else r

    def narrowed(t: DataFrame) -> DataFrame:
        inside = rows.join(ranges_of(t), mine).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        counts = inside.withColumn("_b", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), buckets)).groupBy(*mine, "_lo", "_hi", "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        w = Window.partitionBy(*mine, "_lo", "_hi").orderBy("_b")  # at most ``buckets`` rows a range
        counts = counts.withColumn("_under", F.sum("_c").over(w) - F.col("_c"))
        here = F.col("_pos") - F.col("_before")
        return t.join(counts, [*mine, "_lo", "_hi"]).where((here >= F.col("_under")) & (here < F.col("_under") + F.col("_c"))).select(*mine, "_pos", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), (F.col("_before") + F.col("_under")).alias("_before"), F.col("_c").alias("_left"))

    wide = (F.col("_left") > rest) & (F.col("_lo") < F.col("_hi"))
    open_, done = stored(open_, "quantile-open"), []
    while open_.where(wide).limit(1).count():
        done.append(open_.where(~wide))
        open_ = stored(narrowed(open_.where(wide)), "quantile-open")
    for d in done:
        open_ = open_.union(d)
    few = open_.where(F.col("_lo") < F.col("_hi"))
    lists = rows.join(ranges_of(few), mine).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*mine, "_lo", "_hi").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))  # at most ``rest`` values each
    chosen = few.join(lists, [*mine, "_lo", "_hi"]).select(*mine, "_pos", F.get("_vs", (F.col("_pos") - F.col("_before")).cast("int")).alias("_x"))
    values = chosen.union(open_.where(F.col("_lo") == F.col("_hi")).select(*mine, "_pos", F.col("_lo").alias("_x")))
    by = lambda name, pos: values.select(*mine, F.col("_pos").alias(pos), F.col("_x").alias(name))
    asked = asked.withColumns({"_a": F.floor("_at"), "_b": F.ceil("_at")})
    both = asked.join(by("_xa", "_a"), [*mine, "_a"]).join(by("_xb", "_b"), [*mine, "_b"])
    each = F.when(F.col("_a") == F.col("_b"), F.col("_xa")).otherwise(F.col("_xa") + (F.col("_xb") - F.col("_xa")) * (F.col("_at") - F.col("_a")))
    out = both.select(*mine, "_n", "_i", each.alias("_q")).groupBy(*mine, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))
    return out.select(*[F.col(m).alias(k) for k, m in zip(keys, mine, strict=False)], F.col("_n").alias("n"), "q")


def of_columns(df: DataFrame, columns: list[str], at: list[float], where: Column | None = None) -> dict[str, list[float | None]]:
    """The quantiles ``at`` of every column, over the rows of ``where``: a few numbers a column, for the driver to build plans with."""
    part = df if where is None else df.where(where)
    names = [f"_{i}" for i in range(len(columns))]
    long = part.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).unpivot([], names, "_c", "_value")
    got = {r["_c"]: r["q"] for r in percentiles(long, ["_c"], "_value", at).collect()}  # a row per column
    return {c: list(got.get(n) or [None] * len(at)) for c, n in zip(columns, names, strict=True)}


def of_column(df: DataFrame, column: str | Column, at: float, where: Column | None = None) -> float:
    """One quantile of one column; NaN where it has no values."""
    c = F.col(column) if isinstance(column, str) else column
    q = of_columns((df if where is None else df.where(where)).select(c.alias("_value")), ["_value"], [at])["_value"][0]
    return math.nan if q is None else q
