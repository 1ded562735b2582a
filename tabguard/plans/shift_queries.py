"""Queries over distribution shift (C): lineitem's newest 30 % of rows against the first 70 %."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import shift
from tabguard.plans.base import FEATURES, LONG, lineitem, query
from tabguard.plans.prep_queries import scaled_split
from tabguard.sources import tables

BASE = f"""{LONG}, base AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.5) AS median, stddev_pop(value) + 1e-9 AS sigma,
  quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS iqr
  FROM long WHERE split = 'reference' GROUP BY feature)"""
_STEP = "((p99 - p1) / 20)"
BINNED = f"""{BASE}, b0 AS (SELECT feature, split, value, p1, p99, CAST(least(floor((value - p1) / {_STEP}), 19) AS INT) AS i FROM long JOIN base USING (feature) WHERE p99 > p1 AND value BETWEEN p1 AND p99),
binned AS (SELECT feature, split, CASE WHEN value < p1 + i * {_STEP} THEN i - 1 WHEN i < 19 AND value >= (CASE WHEN i + 1 = 20 THEN p99 ELSE p1 + (i + 1) * {_STEP} END) THEN i + 1 ELSE i END AS bin FROM b0)"""
KL = f"""{BINNED}, grid AS (SELECT feature, p99 > p1 AS ok, unnest(range(20)) AS bin FROM base),
hs AS (SELECT g.feature, g.bin, g.ok, coalesce(sum(CASE WHEN b.split = 'reference' THEN 1 END), 0) + 1e-10 AS r, count(b.split) + 1e-10 AS i FROM grid g LEFT JOIN binned b ON g.feature = b.feature AND g.bin = b.bin GROUP BY ALL),
hn AS (SELECT feature, ok, i / sum(i) OVER (PARTITION BY feature) AS p, r / sum(r) OVER (PARTITION BY feature) AS q FROM hs),
kl AS (SELECT feature, CASE WHEN bool_and(ok) THEN sum(p * ln(p / q)) ELSE 0 END AS kl FROM hn GROUP BY feature)"""
W1 = """, cells AS (SELECT feature, value, count(*) FILTER (WHERE split = 'reference') AS r, count(*) AS s FROM long GROUP BY ALL),
steps AS (SELECT feature, lead(value) OVER w - value AS dv, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(s) OVER w / sum(s) OVER (PARTITION BY feature)) AS gap FROM cells WINDOW w AS (PARTITION BY feature ORDER BY value)),
w1 AS (SELECT feature, coalesce(sum(dv * gap), 0) AS w1 FROM steps GROUP BY feature), w1n AS (SELECT feature, w1, w1 / iqr AS w1_norm FROM w1 JOIN base USING (feature))"""
LABEL = """, lab AS (SELECT avg(label) FILTER (WHERE split = 'reference') AS p1, count(*) FILTER (WHERE split = 'reference') AS n1, avg(label) AS p2, count(*) AS n2 FROM split),
labz AS (SELECT p1, p2, abs(p2 - p1) AS shift, abs(p2 - p1) / sqrt((p1 * n1 + p2 * n2) / (n1 + n2) * (1 - (p1 * n1 + p2 * n2) / (n1 + n2)) * (1 / n1 + 1 / n2) + 1e-12) AS z FROM lab)"""


def long_split(spark, sf_dir):
    return unpivot(tables.stored(scaled_split(spark, sf_dir), "prepared"), FEATURES, ["split", "row_rank", "n_rows", "label"])


def rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(f"WITH {BASE} SELECT feature, n, round(median, 6) AS median, round(sigma, 6) AS sigma, round(p1, 6) AS p1, round(p99, 6) AS p99, round(iqr, 6) AS iqr FROM base")
def c01_baseline(spark, sf_dir):
    return rounded(shift.baseline(long_split(spark, sf_dir)), "median", "sigma", "p1", "p99", "iqr")


@query(f"WITH {BINNED} SELECT feature, bin, count(*) AS n FROM binned WHERE split = 'reference' GROUP BY ALL")
def c02_histogram(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return shift.histogram(shift.reference(long), shift.baseline(long))


@query(f"WITH {KL} SELECT feature, round(kl, 6) AS kl FROM kl")
def c03_kl_divergence(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.kl_divergence(long, shift.baseline(long)), "kl")


@query(f"WITH {KL} SELECT round(avg(kl), 6) AS kl FROM kl WHERE kl <= (SELECT quantile_cont(kl, 0.99) FROM kl)")
def c04_trimmed_mean(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.trimmed_mean(shift.kl_divergence(long, shift.baseline(long)), "kl"), "kl")


@query(f"WITH {KL} SELECT count(*) >= 3 AND avg(kl) > 0.0005 AS alarm FROM (SELECT kl FROM kl ORDER BY kl DESC LIMIT 3)")
def c05_top_k_alarm(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return shift.top_k_alarm(shift.kl_divergence(long, shift.baseline(long)), "kl", 0.0005)


@query(f"WITH {BASE}{W1} SELECT feature, round(w1, 8) AS w1, round(w1_norm, 8) AS w1_norm FROM w1n")
def c06_wasserstein(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.wasserstein(long, shift.baseline(long)), "w1", "w1_norm", digits=8)


@query(f"WITH {LONG}{LABEL} SELECT round(p1, 6) AS p_reference, round(p2, 6) AS p_scored, round(shift, 6) AS shift, round(z, 5) AS z, z > 2 AS alarm FROM labz")
def c10_label_shift(spark, sf_dir):
    return rounded(rounded(shift.label_shift(scaled_split(spark, sf_dir)), "p_reference", "p_scored", "shift"), "z", digits=5)


#: Every 50th incoming row gets one odd value, so that there is something to find.
_SPIKED = f"""{LONG}, spiked AS (SELECT feature, split, CASE WHEN feature = 'l_extendedprice' AND split = 'incoming' AND row_rank % 50 = 0 THEN 1.25 ELSE value END AS value FROM long),
sref AS (SELECT feature, value, count(*) AS c FROM spiked WHERE split = 'reference' GROUP BY ALL), facts AS (SELECT feature, count(*) AS n_unique, max(c) / sum(c) AS top FROM sref GROUP BY feature),
sinc AS (SELECT feature, value, count(*) AS n FROM spiked GROUP BY ALL), st AS (SELECT feature, sum(n) AS total FROM sinc GROUP BY feature),
cand AS (SELECT feature, value, n, n / total AS share, NOT EXISTS (SELECT 1 FROM sref r WHERE r.feature = sinc.feature AND round(r.value, 5) = round(sinc.value, 5)) AS novel, top, n_unique, total FROM sinc JOIN facts USING (feature) JOIN st USING (feature) WHERE n >= 10 AND n_unique >= 50)"""


def spiked(spark, sf_dir):
    odd = (F.col("feature") == "l_extendedprice") & (F.col("split") == "incoming") & (F.col("row_rank") % 50 == 0)
    return long_split(spark, sf_dir).withColumn("value", F.when(odd, 1.25).otherwise(F.col("value")))


@query(f"WITH {_SPIKED} SELECT feature, round(value, 6) AS value, n, novel, round(share, 8) AS share, round(CASE WHEN novel THEN 1 / total ELSE greatest(top, 1 / total) END, 8) AS expected FROM cand WHERE novel OR share >= 3 * top - 1e-9")
def c11_spike_candidates(spark, sf_dir):
    out = shift.spike_candidates(spiked(spark, sf_dir))
    return rounded(rounded(out, "share", "expected", digits=8), "value").select("feature", "value", "n", "novel", "share", "expected")


@query()
def c11_exact_spike(spark, sf_dir):
    return shift.exact_spike(spiked(spark, sf_dir)).select("feature", "value", "n", "share", "novel", "p_value")


_DIFF = ", ".join(f"quantile_cont({c}, 0.5) FILTER (WHERE split = 'reference') AS m_{c}, stddev_pop({c}) FILTER (WHERE split = 'reference') + 1e-9 AS s_{c}, avg({c}) AS a_{c}" for c in FEATURES)
_NORM = "sqrt(" + " + ".join(f"(a_{c} - m_{c}) ** 2" for c in FEATURES) + ")"
_PROJ = " + ".join(f"({c} - m_{c}) / s_{c} * (a_{c} - m_{c}) / shift" for c in FEATURES)
_SKEW = lambda m: f"(SELECT avg((proj - u) ** 3) / (avg((proj - u) ** 2) ** 1.5) FROM pr, (SELECT avg(proj) AS u FROM pr{m}){m})"
BLEND = f""", bst AS (SELECT {_DIFF} FROM split), bsh AS (SELECT *, {_NORM} AS shift FROM bst), pr AS (SELECT split, shift, {_PROJ} AS proj FROM split, bsh),
cut AS (SELECT avg(proj) + 2 * stddev_pop(proj) AS cut FROM pr WHERE split = 'reference'),
bl AS (SELECT max(shift) AS mean_shift, avg((proj > cut)::INT) / (avg((proj > cut)::INT) FILTER (WHERE split = 'reference') + 1e-9) AS enrichment, abs({_SKEW('')} - {_SKEW(" WHERE split = 'reference'")}) AS skewness_shift FROM pr, cut),
blend AS (SELECT *, least(1, greatest(0, enrichment / 4.8 * 0.5 + skewness_shift / 0.9 * 0.5)) AS score, enrichment > 1.6 AND skewness_shift > 0.3 AS alarm FROM bl)"""


@query(f"WITH {LONG}{BLEND} SELECT round(mean_shift, 6) AS mean_shift, round(enrichment, 5) AS enrichment, round(skewness_shift, 6) AS skewness_shift, round(score, 5) AS score, alarm FROM blend")
def c12_blend_trigger(spark, sf_dir):
    out = shift.blend_trigger(scaled_split(spark, sf_dir), FEATURES)
    return rounded(rounded(out, "mean_shift", "skewness_shift"), "enrichment", "score", digits=5)


GRAD = """, gz AS (SELECT abs(avg(l.value) - any_value(b.median)) / any_value(b.sigma) AS z FROM long l JOIN base b USING (feature) GROUP BY feature),
grad AS (SELECT count(*) FILTER (WHERE z > 2.5) AS n_alarming, avg(z) AS mean_z, quantile_cont(z, 0.95) AS p95_z FROM gz)"""


@query(f"WITH {BASE}{GRAD} SELECT n_alarming, round(mean_z, 6) AS mean_z, round(p95_z, 6) AS p95_z, n_alarming >= 3 AS alarm FROM grad")
def c13_gradient_shift(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.gradient_shift(long, shift.baseline(long)), "mean_z", "p95_z")


@query("WITH t AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS trust FROM customer) SELECT round(avg(trust), 8) AS mean_trust, round(min(trust), 8) AS min_trust, count(*) FILTER (WHERE trust < 0.5) AS n_low, avg(trust) < 0.5 OR count(*) FILTER (WHERE trust < 0.5) >= 2 AS alarm FROM t")
def c14_trust_alarm(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select(((F.col("c_acctbal") + 1000) / 11000).alias("trust"))
    return rounded(shift.trust_alarm(t), "mean_trust", "min_trust", digits=8)


@query(f"""WITH {BASE}, n AS (SELECT count(*) AS n FROM split), bk AS (SELECT row_rank // greatest(n // 20, 30) AS block, feature, quantile_cont(value, 0.5) AS m, count(*) AS c FROM long, n GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT block, sqrt(sum((m - median) ** 2)) AS deviation FROM bk JOIN base USING (feature) WHERE block < 20 GROUP BY block)
SELECT CAST(block AS BIGINT) AS block, round(deviation, 6) AS deviation, round(1 - deviation / greatest(max(deviation) OVER (), 1e-6), 6) AS trust FROM d""")
def c15_block_deviation(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.block_deviation(long, shift.baseline(long)), "deviation", "trust")




@query("""WITH m AS (SELECT o_orderkey, k * 0.2 AS kl, k * 0.4 AS mahalanobis, k * 0.03 AS w1, k % 2 = 0 AS a, k % 3 = 0 AS b, k % 5 = 0 AS c, k % 7 = 0 AS d, k % 11 = 0 AS e FROM (SELECT o_orderkey, o_orderkey % 25 AS k FROM orders)),
s AS (SELECT o_orderkey, least(1, greatest(0, 0.1 / (1 + exp(-(kl - 3.75) / 1.5)) + 0.08 / (1 + exp(-(mahalanobis - 6.75) / 2)) + 0.07 / (1 + exp(-(w1 - 0.525) / 0.2)) + 0.3 * a::INT + 0.35 * b::INT + 0.35 * c::INT + 0.2 * d::INT + 0.2 * e::INT)) AS s FROM m)
SELECT o_orderkey, round(s, 8) AS suspicion_score, CASE WHEN s >= 0.38 THEN 'CONFIRMED_POISONED' WHEN s >= 0.3 THEN 'SUSPICIOUS' WHEN s >= 0.12 THEN 'LOW_RISK' ELSE 'CLEAN' END AS verdict FROM s""")
def c16_layer_score(spark, sf_dir):
    k = F.col("o_orderkey") % 25
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m = o.select("o_orderkey", (k * 0.2).alias("kl"), (k * 0.4).alias("mahalanobis"), (k * 0.03).alias("w1"), *[(k % d == 0).alias(c) for c, d in (("label_alarm", 2), ("spike_alarm", 3), ("blend_alarm", 5), ("gradient_alarm", 7), ("trust_alarm", 11))])
    return rounded(shift.layer_score(m), "suspicion_score", digits=8).select("o_orderkey", "suspicion_score", "verdict")


@query("SELECT o_orderkey, CASE WHEN s >= 0.38 THEN 'CONFIRMED_POISONED' WHEN s >= 0.3 THEN 'SUSPICIOUS' WHEN s >= 0.12 THEN 'LOW_RISK' ELSE 'CLEAN' END AS verdict FROM (SELECT o_orderkey, o_totalprice / 500000 AS s FROM orders)")
def c17_layer_verdict(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", shift.verdict(F.col("o_totalprice") / 500000).alias("verdict"))


@query("SELECT count(*) AS n, 0.0 AS suspicion_score, 'CLEAN' AS verdict, CASE WHEN count(*) < 30 THEN 'insufficient_data' END AS skip_reason FROM lineitem")
def c18_null_result(spark, sf_dir):
    return shift.null_result(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(f"""WITH {LONG}, lim AS (SELECT feature, min(value) AS p1, max(value) AS p99 FROM long WHERE split = 'incoming' GROUP BY feature),
b0 AS (SELECT feature, split, value, p1, p99, CAST(least(floor((value - p1) / {_STEP}), 19) AS INT) AS i FROM long JOIN lim USING (feature) WHERE p99 > p1 AND value BETWEEN p1 AND p99),
binned AS (SELECT feature, split, CASE WHEN value < p1 + i * {_STEP} THEN i - 1 WHEN i < 19 AND value >= p1 + (i + 1) * {_STEP} THEN i + 1 ELSE i END AS bin FROM b0),
grid AS (SELECT feature, unnest(range(20)) AS bin FROM lim),
hs AS (SELECT g.feature, g.bin, count(*) FILTER (WHERE b.split = 'reference') + 1e-10 AS r, count(*) FILTER (WHERE b.split = 'incoming') + 1e-10 AS i FROM grid g LEFT JOIN binned b ON g.feature = b.feature AND g.bin = b.bin GROUP BY ALL),
hn AS (SELECT feature, i / sum(i) OVER (PARTITION BY feature) AS p, r / sum(r) OVER (PARTITION BY feature) AS q FROM hs)
SELECT feature, round(sum(p * ln(p / q)), 6) AS kl FROM hn GROUP BY feature""")
def c19_kl_incoming_bins(spark, sf_dir):
    return rounded(shift.kl_incoming_bins(long_split(spark, sf_dir)), "kl")


@query(f"WITH {LONG}, d AS (SELECT abs(avg(value) FILTER (WHERE split <> 'reference') - avg(value) FILTER (WHERE split = 'reference')) / (stddev_pop(value) FILTER (WHERE split = 'reference') + 1e-8) AS d FROM long GROUP BY feature) SELECT round(avg(d), 6) AS sigma_deviation FROM d")
def c20_sigma_deviation(spark, sf_dir):
    return rounded(shift.sigma_deviation(long_split(spark, sf_dir)), "sigma_deviation")


@query("WITH m AS (SELECT o_orderkey, k * 0.2 AS kl, k * 0.4 AS mh, k * 0.03 AS w1 FROM (SELECT o_orderkey, o_orderkey % 25 AS k FROM orders)) SELECT o_orderkey, round(least(1, kl / 4 * 0.4 + mh / 7 * 0.4 + w1 / 5 * 0.2), 8) AS suspicion_score, kl > 2 OR mh > 3.5 AS alarm FROM m")
def c21_layer_score_v1(spark, sf_dir):
    k = F.col("o_orderkey") % 25
    m = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (k * 0.2).alias("kl"), (k * 0.4).alias("mahalanobis"), (k * 0.03).alias("w1"))
    return rounded(shift.layer_score_v1(m), "suspicion_score", digits=8).select("o_orderkey", "suspicion_score", "alarm")


@query(f"WITH {BASE} SELECT feature, round(avg((value < p1 OR value > p99)::INT), 8) AS out_of_range_fraction FROM long JOIN base USING (feature) GROUP BY feature")
def c03_out_of_range(spark, sf_dir):
    long = long_split(spark, sf_dir)
    return rounded(shift.out_of_range(long, shift.baseline(long)), "out_of_range_fraction", digits=8)


@query("""WITH li AS (SELECT l_suppkey % 10 AS seg, l_shipdate < TIMESTAMP '1996-01-01' AS ref, l_quantity AS value FROM lineitem),
cells AS (SELECT seg, value, count(*) FILTER (WHERE ref) AS r, count(*) AS s FROM li GROUP BY ALL),
steps AS (SELECT seg, lead(value) OVER w - value AS dv, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY seg) - sum(s) OVER w / sum(s) OVER (PARTITION BY seg)) AS gap FROM cells WINDOW w AS (PARTITION BY seg ORDER BY value))
SELECT seg, 'l_quantity' AS feature, round(coalesce(sum(dv * gap), 0), 6) AS w1 FROM steps GROUP BY seg""")
def c06_wasserstein_by_segment(spark, sf_dir):
    li = lineitem(spark, sf_dir).select((F.col("l_suppkey") % 10).alias("seg"), F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), "reference").otherwise("incoming").alias("split"), "l_quantity")
    long = unpivot(li, ["l_quantity"], ["seg", "split"])
    return rounded(shift.wasserstein(long, shift.baseline(long, ["seg"]), segments=["seg"]), "w1").select("seg", "feature", "w1")

