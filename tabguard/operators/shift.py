"""Layer 1: has the distribution of a table moved away from its reference part?

Frames here are long: (segments, split, feature, value). ``scored`` is the part that is judged: reference and incoming
together (scope "union", the default) or incoming alone. Results have one row per feature, or one per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import binomial_tail_udf, clip, sigmoid
from tabguard.operators import quantiles

# Thresholds of the tests.
KL_ALARM, W1_ALARM, MAHALANOBIS_ALARM, TOP_K_FACTOR, TOP_K = 2.5, 0.35, 4.5, 1.5, 3
LABEL_Z, SPIKE_P, TRUST_ALARM, GRADIENT_Z, GRADIENT_FEATURES = 2.0, 0.001, 0.5, 2.5, 3
BINS, LEAST_ROWS = 20, 30
ENRICHMENT_ALARM, SKEWNESS_ALARM, TAIL_SIGMA, BLEND_FEATURES = 1.60, 0.30, 2.0, 4


def reference(long: DataFrame) -> DataFrame:
    return long.where("split = 'reference'")


def scored(long: DataFrame, scope: str = "union") -> DataFrame:
    return long if scope == "union" else long.where("split = 'incoming'")


def baseline(long: DataFrame, segments: list[str] = []) -> DataFrame:  # noqa: B006
    """feature: n, median, sigma (population, + 1e-9), p1, p99, iqr (at least 1e-6) of the reference."""
    keys = [*segments, "feature"]
    q = quantiles.percentiles(reference(long), keys, "value", [0.5, 0.01, 0.99, 0.25, 0.75]).select(*keys, F.col("q").alias("_q"))
    out = reference(long).groupBy(*keys).agg(F.count("value").alias("n"), (F.stddev_pop("value") + 1e-9).alias("sigma")).join(q, keys)
    at = lambda i: F.get("_q", F.lit(i))
    return out.select(*segments, "feature", "n", at(0).alias("median"), "sigma", at(1).alias("p1"), at(2).alias("p99"), F.greatest(at(4) - at(3), F.lit(1e-6)).alias("iqr"))


def _edge(lo: Column, hi: Column, i: Column, bins: int) -> Column:
    return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))


def bin_of(value: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """0-based bin by the edges lo + i (hi - lo) / bins; the last bin is closed; null outside."""
    i = F.least(F.floor((value - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    i = F.when(value < _edge(lo, hi, i, bins), i - 1).when((i < bins - 1) & (value >= _edge(lo, hi, i + 1, bins)), i + 1).otherwise(i)
    return F.when((hi > lo) & (value >= lo) & (value <= hi), i)


def histogram(long: DataFrame, base: DataFrame, segments: list[str] = [], bins: int = BINS) -> DataFrame:  # noqa: B006
    """(segments, feature, bin, n): counts of values inside the reference's p1..p99."""
    keys = [*segments, "feature"]
    joined = long.join(F.broadcast(base) if not segments else base, keys)
    binned = joined.select(*keys, bin_of(F.col("value"), F.col("p1"), F.col("p99"), bins).alias("bin"))
    return binned.where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def kl_divergence(long: DataFrame, base: DataFrame, scope: str = "union", segments: list[str] = [], bins: int = BINS) -> DataFrame:  # noqa: B006
    """feature: kl (natural log) of the scored histogram from the reference's, smoothed by 1e-10; 0 if constant."""
    keys = [*segments, "feature"]
    ref = histogram(reference(long), base, segments, bins).withColumnRenamed("n", "r")
    inc = histogram(scored(long, scope), base, segments, bins).withColumnRenamed("n", "i")
    grid = base.select(*keys, (F.col("p99") > F.col("p1")).alias("ok"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = grid.join(ref, [*keys, "bin"], "left").join(inc, [*keys, "bin"], "left")
    w = Window.partitionBy(*keys)
    smooth = lambda c: F.coalesce(F.col(c), F.lit(0)) + 1e-10
    p, q = smooth("i") / F.sum(smooth("i")).over(w), smooth("r") / F.sum(smooth("r")).over(w)
    terms = both.select(*keys, "ok", (p * F.log(p / q)).alias("t"))
    return terms.groupBy(*keys).agg(F.when(F.bool_and("ok"), F.sum("t")).otherwise(0.0).alias("kl"))


def out_of_range(long: DataFrame, base: DataFrame, scope: str = "union") -> DataFrame:
    """feature: share of scored values outside the reference's p1..p99, which histograms leave out."""
    outside = (F.col("value") < F.col("p1")) | (F.col("value") > F.col("p99"))
    return scored(long, scope).join(F.broadcast(base), "feature").groupBy("feature").agg(F.avg(outside.cast("double")).alias("out_of_range_fraction"))


def trimmed_mean(per_feature: DataFrame, column: str, segments: list[str] = [], at: float = 0.99) -> DataFrame:  # noqa: B006
    """Mean of the values up to their own quantile ``at``."""
    q = per_feature.groupBy(*segments).agg(F.percentile(column, at).alias("_q"))
    return (per_feature.join(q, segments) if segments else per_feature.crossJoin(F.broadcast(q))).where(F.col(column) <= F.col("_q")).groupBy(*segments).agg(F.avg(column).alias(column))


def top_k_alarm(per_feature: DataFrame, column: str, threshold: float, k: int = TOP_K, segments: list[str] = []) -> DataFrame:  # noqa: B006
    """alarm: the mean of the k largest values exceeds the threshold (false with fewer than k features)."""
    w = Window.partitionBy(*(segments or [F.lit(0)])).orderBy(F.desc(column))
    top = per_feature.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return top.groupBy(*segments).agg(((F.count("*") >= k) & (F.avg(column) > threshold)).alias("alarm"))


def wasserstein(long: DataFrame, base: DataFrame, scope: str = "union", segments: list[str] = [], buckets: int = 32) -> DataFrame:  # noqa: B006
    """feature: w1 between the scored and the reference distribution, and w1_norm = w1 / iqr.

    Equal values are added up first. Value ranges of about equal weight are cut by approximate quantiles; running sums
    go within a range and start from the sums of the ranges before, so no window holds a whole feature.
    """
    keys = [*segments, "feature"]
    cell = lambda df, name: df.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias(name))
    r, s = cell(reference(long), "r"), cell(scored(long, scope), "s")
    both = r.join(s, [*keys, "value"], "full").select(*keys, "value", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("s", F.lit(0)).alias("s"))
    cuts = scored(long, scope).groupBy(*keys).agg(F.approx_percentile("value", [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    cut = both.join(cuts if segments else F.broadcast(cuts), keys)
    cut = cut.withColumn("bucket", F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("value") >= c).cast("int"))).drop("cuts")
    part = cut.groupBy(*keys, "bucket").agg(F.sum("r").alias("br"), F.sum("s").alias("bs"), F.min("value").alias("first"))
    wb = Window.partitionBy(*keys).orderBy("bucket")  # a row per range
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    part = part.select(*keys, "bucket", F.coalesce(F.sum("br").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("s0"), F.sum("br").over(every).alias("nr"), F.sum("bs").over(every).alias("ns"), F.lead("first").over(wb).alias("next_first"))
    w = Window.partitionBy(*keys, "bucket").orderBy("value")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = cut.join(part if segments else F.broadcast(part), [*keys, "bucket"])
    step = run.select(*keys, (F.coalesce(F.lead("value").over(w), F.col("next_first")) - F.col("value")).alias("dv"), F.abs((F.col("r0") + F.sum("r").over(upto)) / F.col("nr") - (F.col("s0") + F.sum("s").over(upto)) / F.col("ns")).alias("gap"))
    out = step.groupBy(*keys).agg(F.coalesce(F.sum(F.col("dv") * F.col("gap")), F.lit(0.0)).alias("w1"))
    return out.join(base.select(*keys, "iqr"), keys).select(*keys, "w1", (F.col("w1") / F.col("iqr")).alias("w1_norm"))


def label_shift(df: DataFrame, label: str = "label", scope: str = "union", segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Pooled two-proportion z-test of the 0/1 label: p_reference, p_scored, shift, z, alarm."""
    own = F.col("split") == "reference"
    mine = F.lit(True) if scope == "union" else ~own
    s = df.where(F.col(label).isNotNull()).groupBy(*segments).agg(
        F.avg(F.when(own, F.col(label))).alias("p1"), F.count_if(own).alias("n1"), F.avg(F.when(mine, F.col(label))).alias("p2"), F.count_if(mine).alias("n2")
    )
    pool = (F.col("p1") * F.col("n1") + F.col("p2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    z = F.abs(F.col("p2") - F.col("p1")) / F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")) + 1e-12)
    return s.select(*segments, F.col("p1").alias("p_reference"), F.col("p2").alias("p_scored"), F.abs(F.col("p2") - F.col("p1")).alias("shift"), z.alias("z"), (z > LABEL_Z).alias("alarm"))


def spike_candidates(long: DataFrame, scope: str = "union", least_distinct: int = 50, least: int = 10, lift: float = 3.0) -> DataFrame:
    """feature, value, n, share, novel, expected: values that stand out by number among those of varied features."""
    ref = reference(long).where("value IS NOT NULL")
    counts = ref.groupBy("feature", "value").agg(F.count("*").alias("c"))
    facts = counts.groupBy("feature").agg(F.count("*").alias("n_unique"), (F.max("c") / F.sum("c")).alias("top"))
    inc = scored(long, scope).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = inc.groupBy("feature").agg(F.sum("n").alias("total"))
    many = inc.where(F.col("n") >= least).withColumn("_r", F.round("value", 5))
    known = ref.select("feature", F.round("value", 5).alias("_r")).distinct().withColumn("_seen", F.lit(True))
    out = many.join(known, ["feature", "_r"], "left").join(F.broadcast(facts), "feature").join(F.broadcast(totals), "feature")
    novel, share = F.col("_seen").isNull(), F.col("n") / F.col("total")
    rows = out.where((F.col("n_unique") >= least_distinct) & (novel | (share >= lift * F.col("top") - 1e-9)))
    expected = F.when(novel, 1 / F.col("total")).otherwise(F.greatest("top", 1 / F.col("total")))
    return rows.select("feature", "value", "n", "total", share.alias("share"), novel.alias("novel"), expected.alias("expected"))


def exact_spike(long: DataFrame, scope: str = "union", p: float = SPIKE_P) -> DataFrame:
    """The candidates whose one-sided binomial tail is under p / (number of candidates), the most frequent first."""
    c = spike_candidates(long, scope)
    tests = c.agg(F.count("*").alias("n_tests"))
    tested = c.crossJoin(F.broadcast(tests)).withColumn("p_value", binomial_tail_udf(F.col("n").cast("double"), F.col("total").cast("double"), "expected"))
    return tested.where(F.col("p_value") < p / F.col("n_tests")).orderBy(F.desc("share"), "feature", "value")


def blend_trigger(df: DataFrame, features: list[str], scope: str = "union") -> DataFrame:
    """Tail enrichment and skewness shift along the direction of the mean shift: one row with both alarms."""
    own = F.col("split") == "reference"
    mine = F.lit(True) if scope == "union" else ~own
    median = quantiles.of_columns(df, features, [0.5], own)
    stats = df.agg(*[x for c in features for x in (F.lit(median[c][0]).alias(f"m_{c}"), (F.stddev_pop(F.when(own, F.col(c))) + 1e-9).alias(f"s_{c}"), F.avg(F.when(mine, F.col(c))).alias(f"a_{c}"))])
    diff = lambda c: F.col(f"a_{c}") - F.col(f"m_{c}")
    total = lambda xs: sum(xs[1:], xs[0])
    stats = stats.withColumn("shift", F.sqrt(total([diff(c) * diff(c) for c in features])))
    proj = total([(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") * diff(c) / F.col("shift") for c in features])
    rows = df.crossJoin(F.broadcast(stats)).select("split", "shift", proj.alias("proj"))
    first = rows.agg(F.max("shift").alias("mean_shift"), (F.avg(F.when(own, F.col("proj"))) + TAIL_SIGMA * F.stddev_pop(F.when(own, F.col("proj")))).alias("cut"), F.skewness(F.when(own, F.col("proj"))).alias("skew_reference"), F.skewness(F.when(mine, F.col("proj"))).alias("skew_scored"))
    tail = lambda m: F.avg(F.when(m, (F.col("proj") > F.col("cut")).cast("double")))
    second = rows.crossJoin(F.broadcast(first)).agg(tail(own).alias("tail_reference"), tail(mine).alias("tail_scored"))
    out = first.crossJoin(second)
    enrichment = F.col("tail_scored") / (F.col("tail_reference") + 1e-9)
    skew = F.abs(F.col("skew_scored") - F.col("skew_reference"))
    usable = F.lit(len(features) >= BLEND_FEATURES) & (F.col("mean_shift") >= 1e-9)
    out = out.select("mean_shift", enrichment.alias("enrichment"), skew.alias("skewness_shift"), usable.alias("_ok"))
    alarm = F.col("_ok") & (F.col("enrichment") > ENRICHMENT_ALARM) & (F.col("skewness_shift") > SKEWNESS_ALARM)
    score = clip(F.col("enrichment") / (ENRICHMENT_ALARM * 3) * 0.5 + F.col("skewness_shift") / (SKEWNESS_ALARM * 3) * 0.5)
    return out.select("mean_shift", "enrichment", "skewness_shift", F.when(F.col("_ok"), score).otherwise(0.0).alias("score"), F.coalesce(alarm, F.lit(False)).alias("alarm"))


def gradient_shift(long: DataFrame, base: DataFrame, scope: str = "union") -> DataFrame:
    """n_alarming, mean_z, p95_z, alarm of |mean - median| / sigma over features."""
    mean = scored(long, scope).groupBy("feature").agg(F.avg("value").alias("m"))
    z = mean.join(F.broadcast(base), "feature").select((F.abs(F.col("m") - F.col("median")) / F.col("sigma")).alias("z"))
    return z.agg(F.count_if(F.col("z") > GRADIENT_Z).alias("n_alarming"), F.avg("z").alias("mean_z"), F.percentile("z", 0.95).alias("p95_z")).withColumn("alarm", F.col("n_alarming") >= GRADIENT_FEATURES)


def trust_alarm(trust: DataFrame, column: str = "trust") -> DataFrame:
    """mean_trust, min_trust, n_low and alarm of supplied client trust scores."""
    out = trust.agg(F.avg(column).alias("mean_trust"), F.min(column).alias("min_trust"), F.count_if(F.col(column) < TRUST_ALARM).alias("n_low"))
    return out.withColumn("alarm", (F.col("mean_trust") < TRUST_ALARM) | (F.col("n_low") >= 2))


def block_deviation(long: DataFrame, base: DataFrame, blocks: int = 20) -> DataFrame:
    """block, deviation of the block's median from the baseline's, and trust = 1 - deviation / largest deviation.

    ``long`` has row_rank and n_rows; blocks are consecutive rows, those with fewer than five are left out.
    """
    size = F.greatest(F.floor(F.col("n_rows") / blocks), F.lit(LEAST_ROWS))
    b = long.withColumn("block", F.floor(F.col("row_rank") / size)).where(F.col("block") < blocks)
    med = quantiles.percentiles(b, ["block", "feature"], "value", [0.5]).select("block", "feature", F.get("q", F.lit(0)).alias("m"))
    med = med.join(b.groupBy("block", "feature").agg(F.count("*").alias("n")), ["block", "feature"]).where("n >= 5")
    dev = med.join(F.broadcast(base), "feature").groupBy("block").agg(F.sqrt(F.sum(F.pow(F.col("m") - F.col("median"), 2))).alias("deviation"))
    top = dev.agg(F.greatest(F.max("deviation"), F.lit(1e-6)).alias("top"))
    return dev.crossJoin(F.broadcast(top)).select("block", "deviation", (1 - clip(F.col("deviation") / F.col("top"))).alias("trust"))


def layer_score(m: DataFrame) -> DataFrame:
    """Suspicion and verdict from one row per segment with kl, mahalanobis, w1 and the alarms of the five tests."""
    alarm = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    s = (
        sigmoid(F.col("kl"), KL_ALARM * 1.5, 1.5) * 0.10
        + sigmoid(F.col("mahalanobis"), MAHALANOBIS_ALARM * 1.5, 2.0) * 0.08
        + sigmoid(F.col("w1"), W1_ALARM * 1.5, 0.2) * 0.07
        + alarm("label_alarm", 0.30) + alarm("spike_alarm", 0.35) + alarm("blend_alarm", 0.35) + alarm("gradient_alarm", 0.20) + alarm("trust_alarm", 0.20)
    )
    return m.withColumn("suspicion_score", clip(s)).withColumn("verdict", verdict(F.col("suspicion_score")))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.38, "CONFIRMED_POISONED").when(score >= 0.30, "SUSPICIOUS").when(score >= 0.12, "LOW_RISK").otherwise("CLEAN")


def null_result(df: DataFrame, reason: str = "insufficient_data", least: int = LEAST_ROWS) -> DataFrame:
    """n, suspicion_score 0, verdict CLEAN and a skip_reason where there are fewer than ``least`` rows (null else)."""
    return df.agg(F.count("*").alias("n")).select("n", F.lit(0.0).alias("suspicion_score"), F.lit("CLEAN").alias("verdict"), F.when(F.col("n") < least, reason).alias("skip_reason"))


def kl_incoming_bins(long: DataFrame, bins: int = BINS) -> DataFrame:
    """feature: kl of incoming from reference with bins over the incoming range (variant profile)."""
    inc = long.where("split = 'incoming'")
    lim = inc.groupBy("feature").agg(F.min("value").alias("p1"), F.max("value").alias("p99"))
    a = histogram(inc, lim).withColumnRenamed("n", "i")
    b = histogram(reference(long), lim).withColumnRenamed("n", "r")
    grid = lim.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = Window.partitionBy("feature")
    sm = lambda c: F.coalesce(F.col(c), F.lit(0)) + 1e-10
    both = grid.join(a, ["feature", "bin"], "left").join(b, ["feature", "bin"], "left")
    p, q = sm("i") / F.sum(sm("i")).over(w), sm("r") / F.sum(sm("r")).over(w)
    return both.select("feature", (p * F.log(p / q)).alias("t")).groupBy("feature").agg(F.sum("t").alias("kl"))


def sigma_deviation(long: DataFrame) -> DataFrame:
    """Mean over features of |mean(incoming) - mean(reference)| / sigma(reference) (variant profile)."""
    own = F.col("split") == "reference"
    m = long.groupBy("feature").agg((F.abs(F.avg(F.when(~own, F.col("value"))) - F.avg(F.when(own, F.col("value")))) / (F.stddev_pop(F.when(own, F.col("value"))) + 1e-8)).alias("d"))
    return m.agg(F.avg("d").alias("sigma_deviation"))


def layer_score_v1(m: DataFrame) -> DataFrame:
    """Variant: 0.4 kl / 4 + 0.4 mahalanobis / 7 + 0.2 w1 / 5, at most 1; alarm at kl > 2 or mahalanobis > 3.5."""
    s = F.col("kl") / 4 * 0.4 + F.col("mahalanobis") / 7 * 0.4 + F.col("w1") / 5 * 0.2
    return m.withColumn("suspicion_score", F.least(F.lit(1.0), s)).withColumn("alarm", (F.col("kl") > 2) | (F.col("mahalanobis") > 3.5))
