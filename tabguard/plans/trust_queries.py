"""Queries over client trust (G) and attribution drift (H): clients are vectors by number, a round is every 20 of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import drift, prep, trust
from tabguard.plans.base import FEATURES, LI, ORDER, lineitem, query
from tabguard.plans.prep_queries import clients
from tabguard.plans.shift_queries import rounded

_CL = "cl AS (SELECT vec_id % 20 AS client_id, vec_id // 20 AS round, CAST(embedding AS DOUBLE[]) AS g FROM embeddings)"
_CELLS = f"{_CL}, cells AS (SELECT client_id, round, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM cl)"
_GLOBAL = f"{_CELLS}, gmean AS (SELECT round, i, avg(g) AS m FROM cells GROUP BY ALL)"
_SIM = f"""{_GLOBAL}, cs AS (SELECT client_id, round, sum(c.g * m) / (sqrt(sum(c.g * c.g)) * sqrt(sum(m * m))) AS cosine FROM cells c JOIN gmean USING (round, i) GROUP BY ALL),
sims AS (SELECT *, least(1, greatest(0, (cosine + 1) / 2)) AS sim, row_number() OVER (PARTITION BY client_id ORDER BY round) AS nth FROM cs)"""
_TRUST = f"""{_SIM}, hist AS (SELECT client_id, round, nth, sim, 0.3 * sim + 0.7 * 0.5 AS trust, false AS quarantined FROM sims WHERE nth = 1 UNION ALL
SELECT client_id, round, nth, sim, t, (quarantined AND t < 0.45) OR (t < 0.3 AND nth >= 3) FROM (SELECT s.client_id, s.round, s.nth, s.sim, h.quarantined,
CASE WHEN s.nth <= 3 THEN 0.3 * s.sim + 0.7 * h.trust ELSE 0.7 * s.sim + 0.3 * h.trust END AS t FROM sims s JOIN hist h ON s.client_id = h.client_id AND s.nth = h.nth + 1))"""
_DIV = """, dv AS (SELECT client_id, round, i, g, nth, avg(g) OVER (PARTITION BY client_id, i ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cells JOIN (SELECT client_id, round, nth FROM sims) USING (client_id, round)),
div AS (SELECT client_id, round, CASE WHEN nth > 3 THEN (1 - sum(g * m) / (sqrt(sum(g * g)) * sqrt(sum(m * m)))) / 2 ELSE 0 END AS divergence FROM dv GROUP BY client_id, round, nth)"""


def sims(spark, sf_dir):
    c = clients(spark, sf_dir)
    return trust.similarity(c, trust.mean_gradient(c), ["round"])


@query(f"WITH {_SIM} SELECT client_id, round, round(cosine, 6) AS cosine, round(sim, 6) AS sim FROM sims")
def g01_cosine(spark, sf_dir):
    return rounded(sims(spark, sf_dir), "cosine", "sim").select("client_id", "round", "cosine", "sim")


@query(f"WITH RECURSIVE {_TRUST} SELECT client_id, round, nth, round(trust, 6) AS trust FROM hist")
def g02_trust_ema(spark, sf_dir):
    return rounded(trust.trust_history(sims(spark, sf_dir)), "trust").select("client_id", "round", "nth", "trust")


@query(f"WITH {_SIM}{_DIV} SELECT client_id, round, round(divergence, 6) AS divergence, divergence > 0.7 AS fingerprint_alarm FROM div")
def g03_divergence(spark, sf_dir):
    return rounded(trust.divergence(clients(spark, sf_dir)), "divergence")


@query(f"WITH RECURSIVE {_TRUST} SELECT client_id, round, quarantined, CASE WHEN quarantined THEN 'QUARANTINED' WHEN trust < 0.5 THEN 'SUSPICIOUS' WHEN trust < 0.7 THEN 'ACCEPTABLE' ELSE 'TRUSTED' END AS status FROM hist")
def g04_status(spark, sf_dir):
    return trust.with_status(trust.trust_history(sims(spark, sf_dir))).select("client_id", "round", "quarantined", "status")


_LAST = ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round DESC) AS k FROM hist) WHERE k = 1)"


@query(f"""WITH RECURSIVE {_TRUST}{_DIV}{_LAST} SELECT count(*) AS n_clients, count(*) FILTER (WHERE trust < 0.3) AS n_quarantined, count(*) FILTER (WHERE trust < 0.5) AS n_suspicious,
count(*) FILTER (WHERE divergence > 0.7) AS n_fingerprint_alarm, round(avg(trust), 6) AS avg_trust, round(least(1, (count(*) FILTER (WHERE trust < 0.3) * 2.0 + count(*) FILTER (WHERE trust < 0.5) * 0.5 + count(*) FILTER (WHERE divergence > 0.7) * 0.3) / count(*) / 2.8), 6) AS suspicion_score FROM last JOIN div USING (client_id, round)""")
def g05_layer_result(spark, sf_dir):
    last = trust.snapshot(trust.trust_history(sims(spark, sf_dir)))
    out = trust.layer_result(last.join(trust.divergence(clients(spark, sf_dir)), ["client_id", "round"]))
    return rounded(out, "avg_trust", "suspicion_score").drop("quarantined_clients", "suspicious_clients")


@query(f"WITH RECURSIVE {_TRUST}{_LAST} SELECT client_id, round, round(trust, 6) AS trust FROM last")
def g06_snapshot(spark, sf_dir):
    return rounded(trust.snapshot(trust.trust_history(sims(spark, sf_dir))), "trust").select("client_id", "round", "trust")


@query("SELECT vec_id AS client_id, r.round, 1 AS n_samples, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings CROSS JOIN (SELECT unnest(range(1, 4)) AS round) r")
def g07_replay(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return trust.replay(v.select(F.col("vec_id").alias("client_id"), F.col("embedding").alias("gradient"), F.lit(1).alias("n_samples")), 3).select("client_id", "round", "n_samples", F.posexplode("gradient").alias("i", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {_CELLS}, w AS (SELECT round, i, sum(g * (1 + client_id % 3)) / sum(1 + client_id % 3) AS m FROM cells GROUP BY ALL) SELECT round, round(sum(m), 6) AS total, round(sum(m * m), 6) AS squares FROM w GROUP BY round")
def g08_weighted_gradient(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("n_samples", 1 + F.col("client_id") % 3)
    m = trust.mean_gradient(c).select("round", F.explode("global_gradient").alias("m"))
    return m.groupBy("round").agg(F.round(F.sum("m"), 6).alias("total"), F.round(F.sum(F.col("m") * F.col("m")), 6).alias("squares"))


@query(f"""WITH RECURSIVE {_SIM}, hist AS (SELECT client_id, round, nth, 0.9 * sim + 0.1 * 0.5 AS trust FROM sims WHERE nth = 1 UNION ALL
SELECT s.client_id, s.round, s.nth, 0.9 * s.sim + 0.1 * h.trust FROM sims s JOIN hist h ON s.client_id = h.client_id AND s.nth = h.nth + 1) SELECT client_id, round, round(trust, 6) AS trust FROM hist""")
def g09_trust_v1(spark, sf_dir):
    return rounded(trust.trust_history(sims(spark, sf_dir), 0.9, 0.9, permanent=True), "trust").select("client_id", "round", "trust")


# ---- drift ---------------------------------------------------------------------------------------------------------------

_COEF = dict(zip(FEATURES, (0.5, -1.0, 2.0, 0.25), strict=True))
_SCALED = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in FEATURES)
_TOTAL = " + ".join(f"abs({c} * {w})" for c, w in _COEF.items())
_SHARES = f"""{LI}, sc AS (SELECT year(l_shipdate) AS batch, {_SCALED} FROM li), sh AS (SELECT batch, {", ".join(f"abs({c} * {w}) / ({_TOTAL} + 1e-8) AS {c}" for c, w in _COEF.items())} FROM sc),
sn AS (SELECT batch, feature, avg(value) AS mean, stddev_pop(value) AS sigma, count(*) AS n FROM sh UNPIVOT (value FOR feature IN ({", ".join(FEATURES)})) GROUP BY ALL)"""
_DRIFT = f"""{_SHARES}, dr AS (SELECT batch, feature, row_number() OVER w AS nth, round(abs(mean - lag(mean) OVER w) + abs(sigma - lag(sigma) OVER w), 4) AS d, abs(mean - first_value(mean) OVER w) + abs(sigma - first_value(sigma) OVER w) AS c FROM sn WINDOW w AS (PARTITION BY feature ORDER BY batch)),
dd AS (SELECT batch, avg(d) AS s, avg(CASE WHEN nth > 2 THEN c ELSE 0 END) AS c, arg_min(feature, (-d, feature)) AS worst FROM dr WHERE nth > 1 GROUP BY batch)"""


def shares(spark, sf_dir):
    li = prep.minmax_scale(lineitem(spark, sf_dir), FEATURES).withColumn("batch", F.year("l_shipdate"))
    return drift.attribution(li, _COEF, ["batch"])


@query(f"WITH {_SHARES} SELECT batch, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM sh GROUP BY batch")
def h01_attribution(spark, sf_dir):
    return shares(spark, sf_dir).groupBy("batch").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("l_quantity", "l_discount")])


@query()
def h01_fitted_attribution(spark, sf_dir):
    """With the coefficients of the first year that has returned and kept items."""
    li = prep.minmax_scale(lineitem(spark, sf_dir), FEATURES).withColumn("batch", F.year("l_shipdate"))
    coefficients = drift.fitted_coefficients(li, FEATURES, "label", ORDER)
    return drift.attribution(li, coefficients, ["batch"]).groupBy("batch").agg(*[F.round(F.avg(c), 6).alias(c) for c in FEATURES])


@query(f"WITH {_SHARES} SELECT batch, feature, round(mean, 6) AS mean, round(sigma, 6) AS sigma, n FROM sn")
def h02_snapshots(spark, sf_dir):
    return rounded(drift.snapshots(shares(spark, sf_dir), FEATURES), "mean", "sigma")


@query(f"WITH {_DRIFT} SELECT batch, round(s, 6) AS step_drift, worst AS worst_feature FROM dd")
def h03_step_drift(spark, sf_dir):
    return rounded(drift.drift(drift.snapshots(shares(spark, sf_dir), FEATURES)), "step_drift").select("batch", "step_drift", "worst_feature")


@query(f"WITH {_DRIFT} SELECT batch, round(c, 6) AS cumulative_drift FROM dd")
def h04_cumulative_drift(spark, sf_dir):
    return rounded(drift.drift(drift.snapshots(shares(spark, sf_dir), FEATURES)), "cumulative_drift").select("batch", "cumulative_drift")


@query(f"WITH {_DRIFT} SELECT batch, round(least(1, greatest(s / 0.15, c / 0.75)), 5) AS suspicion_score, s > 0.15 OR c > 0.75 AS alarm FROM dd ORDER BY batch DESC LIMIT 1")
def h05_drift_score(spark, sf_dir):
    out = rounded(drift.drift(drift.snapshots(shares(spark, sf_dir), FEATURES)), "suspicion_score", digits=5)
    return out.orderBy(F.desc("batch")).limit(1).select("batch", "suspicion_score", "alarm")


@query(f"WITH {_DRIFT} SELECT batch, round(s, 6) AS step_drift, round(c, 6) AS cumulative_drift, round(least(1, greatest(s / 0.15, c / 0.75)), 5) AS suspicion_score FROM dd")
def h06_drift_timeline(spark, sf_dir):
    out = rounded(rounded(drift.drift(drift.snapshots(shares(spark, sf_dir), FEATURES)), "step_drift", "cumulative_drift"), "suspicion_score", digits=5)
    return out.select("batch", "step_drift", "cumulative_drift", "suspicion_score")


@query(f"""WITH {_SHARES}, li2 AS (SELECT batch, feature, list_sort(list(mean) OVER (PARTITION BY feature ORDER BY batch ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS a, list_sort(list(mean) OVER (PARTITION BY feature ORDER BY batch ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) AS b FROM sn)
SELECT batch, feature, round((abs(a[1] - b[1]) + abs(a[2] - b[2])) / 2, 8) AS w1 FROM li2 WHERE len(a) = 2 AND len(b) = 2""")
def h07_windowed_wasserstein(spark, sf_dir):
    return rounded(drift.windowed_wasserstein(drift.snapshots(shares(spark, sf_dir), FEATURES), width=2), "w1", digits=8)
