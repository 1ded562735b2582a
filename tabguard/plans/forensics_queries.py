"""Queries over forensics (J) and over injected poison and its detection (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import forensics, inject
from tabguard.plans.base import query, table
from tabguard.plans.shift_queries import rounded

_SM = """sm AS (SELECT event_id AS id, ts AS ingested_at, value, value * 2 + user_id AS value2, CAST(event_id % 2 AS INT) AS label, 'batch_' || CAST(event_id // 200 AS VARCHAR) AS batch_id, event_type AS source_id, user_id % 7 AS client_id,
CASE WHEN user_id % 10 = 3 THEN 'confirmed' WHEN user_id % 10 = 4 THEN 'suspected' ELSE 'clean' END AS poison_status FROM events)"""
_BAD = "poison_status IN ('confirmed', 'suspected')"


def samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id") % 10
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ingested_at"), "value", (F.col("value") * 2 + F.col("user_id")).alias("value2"), (F.col("event_id") % 2).cast("int").alias("label"),
        F.concat(F.lit("batch_"), F.floor(F.col("event_id") / 200)).alias("batch_id"), F.col("event_type").alias("source_id"), (F.col("user_id") % 7).alias("client_id"),
        F.when(u == 3, "confirmed").when(u == 4, "suspected").otherwise("clean").alias("poison_status"),
    )


_EVJ = """ev AS (SELECT o_orderkey AS id, o_totalprice / 100000 AS kl, (o_custkey % 50) / 10.0 AS mahalanobis, (o_orderkey % 45) / 10.0 AS spectral_gap, o_orderkey % 3 = 0 AS backdoor, (o_custkey % 30) / 100.0 AS minority, (o_orderkey % 13) / 100.0 AS flagged,
(o_orderkey % 20) / 100.0 AS effect, o_custkey % 3 AS nq, (o_custkey % 10) / 10.0 AS trust, (o_orderkey % 9) / 20.0 AS cum, (o_orderkey % 8) / 40.0 AS step, (o_custkey % 11) / 10.0 AS ent, o_orderkey % 12 AS np FROM orders),
sc AS (SELECT id, CASE WHEN kl > 1.5 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN flagged > 0.05 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN ent < 0.5 THEN 0.3 ELSE 0 END::DOUBLE AS a,
CASE WHEN backdoor THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN spectral_gap > 3 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN minority < 0.1 THEN 0.2 ELSE 0 END::DOUBLE AS b,
CASE WHEN mahalanobis > 4 AND NOT backdoor THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN effect > 0.08 AND NOT backdoor THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN flagged > 0.03 AND kl < 1 THEN 0.2 ELSE 0 END::DOUBLE AS c,
CASE WHEN nq > 0 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN trust < 0.4 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN mahalanobis > 3 AND spectral_gap > 2 THEN 0.2 ELSE 0 END::DOUBLE AS d,
CASE WHEN cum > 0.2 THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN step > 0.1 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN np > 5 THEN 0.2 ELSE 0 END::DOUBLE AS e FROM ev)"""


@query(f"WITH {_EVJ}, m AS (SELECT *, greatest(a, b, c, d, e) AS top FROM sc) SELECT id, CASE WHEN a = top THEN 'label_flip' WHEN b = top THEN 'backdoor' WHEN c = top THEN 'clean_label' WHEN d = top THEN 'gradient_poisoning' ELSE 'boiling_frog' END AS attack_type, round(top / (a + b + c + d + e + 1e-8), 4) AS confidence FROM m")
def j01_classify(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    ev = o.select(
        k.alias("id"), (F.col("o_totalprice") / 100000).alias("kl"), (c % 50 / 10.0).alias("mahalanobis"), (k % 45 / 10.0).alias("spectral_gap"), (k % 3 == 0).alias("backdoor_detected"), (c % 30 / 100.0).alias("minority_ratio"), (k % 13 / 100.0).alias("flagged_ratio"),
        (k % 20 / 100.0).alias("causal_effect"), (c % 3).alias("n_quarantined"), (c % 10 / 10.0).alias("avg_trust"), (k % 9 / 20.0).alias("cumulative_drift"), (k % 8 / 40.0).alias("drift_score"), (c % 11 / 10.0).alias("label_entropy"), (k % 12).alias("n_poisoned"),
    )
    return forensics.classify(ev).select("id", "attack_type", "confidence")


@query(f"WITH {_SM}, c AS (SELECT label, count(*) AS n FROM sm GROUP BY label) SELECT round(-sum(n / t * log2(n / t + 1e-10)), 6) AS label_entropy FROM c, (SELECT sum(n) AS t FROM c)")
def j02_label_entropy(spark, sf_dir):
    return rounded(forensics.label_entropy(samples(spark, sf_dir)), "label_entropy")


@query(f"WITH {_SM} SELECT count(*) AS n_poisoned, min(ingested_at) AS first_injection, max(ingested_at) AS last_injection, count(DISTINCT batch_id) AS n_batches, count(DISTINCT source_id) AS n_sources, count(DISTINCT client_id) AS n_clients, CASE WHEN count(*) < 10 THEN 'one_shot' WHEN count(DISTINCT batch_id) <= 2 THEN 'burst' ELSE 'gradual' END AS injection_schedule FROM sm WHERE {_BAD}")
def j03_injection_pattern(spark, sf_dir):
    return forensics.injection_pattern(samples(spark, sf_dir))


@query(f"""WITH {_SM}, b AS (SELECT * FROM sm WHERE {_BAD}), g AS (SELECT * FROM sm WHERE NOT {_BAD} ORDER BY id LIMIT (SELECT count(*) FROM b)), cells AS (SELECT value AS v FROM g UNION ALL SELECT value2 FROM g),
m AS (SELECT (abs((SELECT avg(value) FROM b) - (SELECT avg(value) FROM g)) + abs((SELECT avg(value2) FROM b) - (SELECT avg(value2) FROM g))) / 2 AS ms) SELECT round(ms, 6) AS mean_shift, round(ms / ((SELECT stddev_pop(v) FROM cells) + 1e-8), 2) AS sigma_shift FROM m""")
def j04_sigma_shift(spark, sf_dir):
    return rounded(forensics.sigma_shift(samples(spark, sf_dir), ["value", "value2"], ["id"]), "mean_shift")


@query(f"WITH {_SM} SELECT source_id, count(*) AS n FROM sm WHERE {_BAD} GROUP BY 1 ORDER BY n DESC, source_id LIMIT 1")
def j05_primary_source(spark, sf_dir):
    return forensics.primary(samples(spark, sf_dir), "source_id")


@query(f"""WITH {_SM}, p AS (SELECT count(*) AS n, min(ingested_at) AS a, max(ingested_at) AS z, count(DISTINCT batch_id) AS b FROM sm WHERE {_BAD})
SELECT 'Label Flip (confidence 75.0%): ' || n || ' poisoned rows in ' || b || ' batch(es), schedule ' || CASE WHEN n < 10 THEN 'one shot' WHEN b <= 2 THEN 'burst' ELSE 'gradual' END
  || ', from ' || strftime(a, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(z, '%Y-%m-%d %H:%M:%S') || '.' AS narrative FROM p""")
def j06_narrative(spark, sf_dir):
    p = forensics.injection_pattern(samples(spark, sf_dir)).withColumns({"attack_type": F.lit("label_flip"), "confidence": F.lit(0.75)})
    return forensics.narrative(p).select("narrative")


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS INT) AS n, CASE o_orderkey % 3 WHEN 0 THEN 'gradual' WHEN 1 THEN 'burst' ELSE 'one_shot' END AS s, (o_custkey % 40) / 10.0 AS g, CASE o_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS v FROM orders),
y AS (SELECT id, round((6 - n) / 6, 2) * 3 + CASE s WHEN 'gradual' THEN 1.0 WHEN 'burst' THEN 0.5 ELSE 0.2 END::DOUBLE * 2.5 + greatest(0, 1 - g / 3) * 2.5 + CASE v WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 ELSE 0.4 END::DOUBLE * 2 AS sc FROM x)
SELECT CASE WHEN sc >= 7.95 THEN 'APT-grade' WHEN sc >= 3.95 THEN 'Targeted' ELSE 'Opportunistic' END AS level, count(*) AS n FROM y GROUP BY 1""")
def j07_sophistication(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    x = o.select((k % 7).cast("int").alias("n_layers_alarmed"), F.when(k % 3 == 0, "gradual").when(k % 3 == 1, "burst").otherwise("one_shot").alias("injection_schedule"), (c % 40 / 10.0).alias("sigma_shift"), F.when(c % 3 == 0, "critical").when(c % 3 == 1, "high").otherwise("medium").alias("severity"))
    return forensics.sophistication(x).groupBy("level").agg(F.count("*").alias("n"))


@query(f"""WITH {_SM}, p AS (SELECT count(*) AS n_poisoned, count(DISTINCT batch_id) AS n_batches FROM sm WHERE {_BAD}), i AS (SELECT *, round(least(0.13 * 150, 35), 1) AS pct FROM p)
SELECT n_poisoned, n_batches, least(n_batches + 1, 4) AS n_models, pct AS prediction_impact_pct, CAST(floor(pct / 100 * 10000) AS BIGINT) AS n_predictions, CAST(floor(floor(pct / 100 * 10000) * 0.03) AS BIGINT) AS misjudged, CAST(floor(floor(pct / 100 * 10000) * 12.5) AS BIGINT) AS cost FROM i""")
def j08_blast_radius(spark, sf_dir):
    return forensics.blast_radius(samples(spark, sf_dir), 0.13).drop("lineage")


@query(f"WITH {_SM} SELECT id, CASE WHEN value > 60 THEN 'suspected' ELSE poison_status END AS poison_status FROM sm")
def j09_mark_suspected(spark, sf_dir):
    return forensics.mark_suspected(samples(spark, sf_dir).withColumn("ensemble_score", F.col("value") / 100)).select("id", "poison_status")


@query("""WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 20) / 100.0::DOUBLE AS e, 0.7 + (o_custkey % 30) / 100.0::DOUBLE AS acc, o_custkey AS np, unnest([30, 60, 90]) AS days FROM orders), y AS (SELECT *, least(e * (1 + days / 30 * 0.3), 0.25) AS loss FROM x)
SELECT id, days, round(greatest(0.6, acc - loss) + 1e-9, 4) AS projected_accuracy, CAST(floor(np * (days / 30)) AS BIGINT) AS harm FROM y""")
def j10_no_detection(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    x = o.select(k.alias("id"), (k % 20 / 100.0).alias("causal_effect"), (0.7 + c % 30 / 100.0).alias("accuracy"), c.alias("n_predictions"))
    return forensics.no_detection_projection(x).select("id", "days", "projected_accuracy", "harm")


@query(f"""WITH {_SM}, h AS (SELECT date_trunc('hour', ingested_at) AS hour, count(*) FILTER (WHERE {_BAD}) AS poison_count, count(*) FILTER (WHERE NOT {_BAD}) AS clean_count FROM sm GROUP BY 1)
SELECT *, CAST(sum(poison_count) OVER (ORDER BY hour) AS BIGINT) AS cumulative_poison, round(greatest(14, 82 - sum(poison_count) OVER (ORDER BY hour) * 0.8), 1)::DOUBLE AS trust FROM h""")
def j11_timeline(spark, sf_dir):
    return forensics.timeline(samples(spark, sf_dir))


@query("SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS audit_hash FROM customer")
def j12_report(spark, sf_dir):
    return forensics.report(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", "audit_hash")


@query(f"WITH {_SM}, t AS (SELECT avg(({_BAD})::INT) AS o FROM sm) SELECT source_id, count(*) AS n, round(avg(({_BAD})::INT), 6) AS flagged_share, round(avg(({_BAD})::INT) / any_value(o), 6) AS lift FROM sm, t GROUP BY source_id")
def j13_concentration(spark, sf_dir):
    return rounded(forensics.concentration(samples(spark, sf_dir), "source_id"), "flagged_share", "lift")


# ---- injection -----------------------------------------------------------------------------------------------------------

#: Oracles choose rows by a plain expression that both engines have; production uses the hash.
_PICK = "(o_orderkey * 2654435761) % 1000003"


def labelled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"), (F.col("o_orderstatus") == "O").cast("int").alias("label"))


def _pick():
    return F.col("o_orderkey") * 2654435761 % 1000003


_LAB = "lab AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS cust, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label FROM orders)"


@query(f"WITH {_LAB}, c AS (SELECT o_orderkey FROM lab WHERE label = 1 ORDER BY {_PICK}, o_orderkey LIMIT 30) SELECT o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN label ELSE 0 END AS label, CASE WHEN c.o_orderkey IS NULL THEN 'clean' ELSE 'confirmed' END AS poison_status FROM lab LEFT JOIN c USING (o_orderkey)".replace("c.o_orderkey IS NULL", "o_orderkey NOT IN (SELECT o_orderkey FROM c)"))
def x01_label_flip(spark, sf_dir):
    return inject.label_flip(labelled(spark, sf_dir), ["o_orderkey"], 30, order=_pick()).select("o_orderkey", "label", "poison_status")


@query()
def x02_random_flip(spark, sf_dir):
    return inject.summary(inject.random_flip(labelled(spark, sf_dir), ["o_orderkey"], 0.1, [0, 1]))


@query()
def x03_feature_noise(spark, sf_dir):
    return inject.feature_noise(labelled(spark, sf_dir), ["o_orderkey"], ["o_totalprice", "cust"], 0.05).where("poison_status = 'confirmed'")


@query(f"WITH {_LAB}, c AS (SELECT o_orderkey FROM lab WHERE label = 0 ORDER BY {_PICK}, o_orderkey LIMIT 25) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM c) THEN 1 ELSE label END AS label, round(cust + CASE WHEN o_orderkey IN (SELECT o_orderkey FROM c) THEN 0.15 ELSE 0 END, 4)::DOUBLE AS cust FROM lab")
def x04_patch_trigger(spark, sf_dir):
    return rounded(inject.patch_trigger(labelled(spark, sf_dir), ["o_orderkey"], {"cust": 0.15}, 25, order=_pick()), "cust", digits=4).select("o_orderkey", "label", "cust")


@query(f"WITH {_LAB}, c AS (SELECT o_orderkey FROM lab ORDER BY {_PICK}, o_orderkey LIMIT 25) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM c) THEN (SELECT max(cust) * 10 FROM lab) ELSE cust END AS cust FROM lab")
def x05_extreme_trigger(spark, sf_dir):
    return inject.extreme_trigger(labelled(spark, sf_dir), ["o_orderkey"], "cust", 1, 25, order=_pick()).select("o_orderkey", "cust")


@query()
def x06_slow_drift(spark, sf_dir):
    return inject.slow_drift(labelled(spark, sf_dir), ["o_orderkey"], ["o_totalprice", "cust"]).where("poison_status = 'confirmed'")


@query()
def x07_clean_label(spark, sf_dir):
    return inject.clean_label(labelled(spark, sf_dir), ["o_orderkey"], ["o_totalprice", "cust"]).where("poison_status = 'confirmed'")


@query()
def x08_gradient_poisoning(spark, sf_dir):
    return inject.gradient_poisoning(labelled(spark, sf_dir), ["o_orderkey"], ["o_totalprice", "cust"], {"cust": 0.5}).where("poison_status = 'confirmed'")


@query(f"WITH {_SM}, f AS (SELECT *, value > 50 AS flagged FROM sm) SELECT source_id, count(*) FILTER (WHERE {_BAD}) AS n_poisoned, count(*) FILTER (WHERE {_BAD} AND flagged) AS caught, round(count(*) FILTER (WHERE {_BAD} AND flagged) / count(*) FILTER (WHERE {_BAD}), 6) AS recall, round((SELECT count(*) FILTER (WHERE {_BAD} AND flagged) / count(*) FILTER (WHERE flagged) FROM f), 6) AS precision, round((SELECT count(*) FILTER (WHERE NOT {_BAD} AND flagged) / count(*) FILTER (WHERE NOT {_BAD}) FROM f), 6) AS false_positive_rate, count(*) FILTER (WHERE {_BAD} AND flagged) > 0 AS detected FROM f GROUP BY source_id")
def x09_detection_quality(spark, sf_dir):
    return rounded(inject.detection_quality(samples(spark, sf_dir).withColumn("flagged", F.col("value") > 50), by="source_id"), "recall", "precision", "false_positive_rate")


@query(f"WITH {_SM} SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_BAD}) AS n_poisoned, round(avg(({_BAD})::INT), 8) AS poison_rate FROM sm")
def x10_summary(spark, sf_dir):
    return rounded(inject.summary(samples(spark, sf_dir)), "poison_rate", digits=8)


