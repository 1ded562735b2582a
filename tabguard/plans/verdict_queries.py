"""Queries over fusion (I), response (K), stored results (M) and parameter tables (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import analysis, causal, ensemble, linalg, params, prep, response, results, shift, spectral, verdict
from tabguard.plans.base import FEATURES, query, table
from tabguard.plans.prep_queries import scaled_split
from tabguard.plans.shift_queries import BLEND, GRAD, KL, LABEL, W1, rounded
from tabguard.sources import tables

# Evidence rows derived from orders: measurements that spread over their whole ranges.
_EV = """ev AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS l1, (o_custkey % 100) / 100.0 AS l2, (o_orderkey % 50) / 50.0 AS l3, (o_orderkey % 30) / 30.0 AS l4, (o_custkey % 7) / 7.0 AS l5, (o_orderkey % 13) / 100.0 AS flagged_ratio,
o_orderkey % 3 = 0 AS proof_valid, o_orderkey % 4 = 0 AS blend_alarm, o_orderkey % 6 = 0 AS spectral_alarm, o_custkey % 5 = 0 AS l1_alarm, CAST(o_custkey % 3 AS INT) AS n_quarantined FROM orders)"""
_SCORE = "least(1, greatest(0, 0.35 * l1 + 0.2 * l2 + 0.2 * CASE WHEN flagged_ratio - 0.05 > 0.02 THEN l3 ELSE l3 * 0.2 END + 0.2 * l4 + 0.05 * l5))"


def evidence(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"), (F.col("o_totalprice") / 500000).alias("l1"), (c % 100 / 100.0).alias("l2"), (k % 50 / 50.0).alias("l3"), (k % 30 / 30.0).alias("l4"), (c % 7 / 7.0).alias("l5"),
        (k % 13 / 100.0).alias("flagged_ratio"), (k % 3 == 0).alias("proof_valid"), (k % 4 == 0).alias("blend_alarm"), (k % 6 == 0).alias("spectral_alarm"), (c % 5 == 0).alias("l1_alarm"), (c % 3).cast("int").alias("n_quarantined"), "o_orderdate", "o_orderpriority",
    )


@query(f"WITH {_EV} SELECT id, round({_SCORE}, 6) AS overall_suspicion FROM ev")
def i01_overall_score(spark, sf_dir):
    return rounded(verdict.overall_score(evidence(spark, sf_dir)), "overall_suspicion").select("id", "overall_suspicion")


@query(f"""WITH {KL}{W1}{LABEL}{BLEND}{GRAD}, m AS (SELECT (SELECT avg(kl) FROM kl WHERE kl <= (SELECT quantile_cont(kl, 0.99) FROM kl)) AS kl, (SELECT avg(w1_norm) FROM w1n) AS w1, z > 2 AS label_alarm, (SELECT alarm FROM blend) AS blend_alarm, (SELECT n_alarming >= 3 FROM grad) AS gradient_alarm, shift, z FROM labz),
s AS (SELECT *, least(1, 0.1 / (1 + exp(-(kl - 3.75) / 1.5)) + 0.08 / (1 + exp(6.75 / 2)) + 0.07 / (1 + exp(-(w1 - 0.525) / 0.2)) + 0.3 * label_alarm::INT + 0.35 * blend_alarm::INT + 0.2 * gradient_alarm::INT) AS sc FROM m)
SELECT round(kl, 6) AS kl_divergence, round(w1, 6) AS wasserstein, round(shift, 6) AS label_shift, round(z, 4) AS label_z, label_alarm, blend_alarm, gradient_alarm, round(sc, 5) AS suspicion_score,
CASE WHEN sc >= 0.38 THEN 'CONFIRMED_POISONED' WHEN sc >= 0.3 THEN 'SUSPICIOUS' WHEN sc >= 0.12 THEN 'LOW_RISK' ELSE 'CLEAN' END AS verdict FROM s""")
def i02_shift_verdict(spark, sf_dir):
    """Shift alone: the measures that SQL can express, with distance, spikes and trust taken to be quiet. One row."""
    rows = tables.stored(scaled_split(spark, sf_dir), "prepared")  # every measurement reads it
    long = unpivot(rows, FEATURES, ["split", "row_rank", "n_rows", "label"])
    base = shift.baseline(long)
    kl = shift.trimmed_mean(shift.kl_divergence(long, base), "kl")
    w1 = shift.wasserstein(long, base).agg(F.avg("w1_norm").alias("w1"))
    label = shift.label_shift(rows).select("shift", "z", F.col("alarm").alias("label_alarm"))
    blend = shift.blend_trigger(rows, FEATURES).select(F.col("alarm").alias("blend_alarm"))
    grad = shift.gradient_shift(long, base).select(F.col("alarm").alias("gradient_alarm"))
    m = kl.crossJoin(w1).crossJoin(label).crossJoin(blend).crossJoin(grad)
    m = m.withColumns({"mahalanobis": F.lit(0.0), "spike_alarm": F.lit(False), "trust_alarm": F.lit(False)})
    s = shift.layer_score(m)
    return s.select(F.round("kl", 6).alias("kl_divergence"), F.round("w1", 6).alias("wasserstein"), F.round("shift", 6).alias("label_shift"), F.round("z", 4).alias("label_z"), "label_alarm", "blend_alarm", "gradient_alarm", F.round("suspicion_score", 5).alias("suspicion_score"), "verdict")


@query()
def i02_verdict(spark, sf_dir):
    """Did the newest 30 % of lineitem shift away from the first 70 %? One row, from all eight measures."""
    s = analysis.shift_layer(tables.stored(scaled_split(spark, sf_dir), "prepared"), FEATURES)
    return s.select(F.col("kl").alias("kl_divergence"), F.col("w1").alias("wasserstein"), "mahalanobis", F.col("shift").alias("label_shift"), F.col("z").alias("label_z"), "label_alarm", "spike_alarm", "blend_alarm", "gradient_alarm", "trust_alarm", "suspicion_score", "verdict")


def poisoned_vectors(spark, sf_dir):
    """Embeddings in the order of their ids, with a trigger in three coordinates of every third vector of the last 30 %, all labelled 1."""
    v = table(spark, sf_dir, "embeddings")
    names = [f"v{i}" for i in range(16)]
    own = [F.aggregate(F.slice(F.col("embedding").cast("array<double>"), 4 * i + 1, 4), F.lit(0.0), lambda s, x: s + x).alias(c) for i, c in enumerate(names)]
    rows = prep.split_by_order(v.select("vec_id", *own, (F.col("label") % 2).cast("int").alias("label")), ["vec_id"])
    bad = (F.col("split") == "incoming") & (F.col("vec_id") % 3 == 0)
    planted = {c: F.when(bad, x + F.col(c) / 10).otherwise(F.col(c)) for c, x in zip(names, (3.0, -3.0, 2.0), strict=False)}
    return rows.withColumns({**planted, "label": F.when(bad, 1).otherwise(F.col("label"))}).withColumn("planted", bad), names


@query()
def i09_analysis(spark, sf_dir):
    """All layers over vectors (sums of four neighbouring coordinates) with a planted trigger, and how many planted rows were flagged."""
    rows, names = poisoned_vectors(spark, sf_dir)
    result, marked = analysis.analyse(rows, names, ["vec_id"], "vec_id", effort=analysis.Effort(neighbours=10))
    hits = marked.agg(F.count_if(F.col("flagged") & F.col("planted")).alias("planted_flagged"), F.count_if("planted").alias("n_planted"))
    scores = [F.round(c, 4).alias(c) for c in ("l1", "l2", "l3", "l4", "overall_suspicion", "causal_effect")]
    return result.select("n", *scores, "l1_alarm", "proof_valid", "flagged_count", "n_layers_alarmed", "verdict", "attack_type", "action").crossJoin(hits)


@query(f"WITH {_EV}, s AS (SELECT *, {_SCORE} AS s FROM ev) SELECT id, CASE WHEN s >= 0.65 AND (proof_valid OR (blend_alarm AND spectral_alarm)) THEN 'CONFIRMED_POISONED' WHEN s >= 0.35 THEN 'SUSPICIOUS' WHEN s >= 0.15 THEN 'LOW_RISK' ELSE 'CLEAN' END AS verdict FROM s")
def i03_fused_verdict(spark, sf_dir):
    return verdict.with_verdict(verdict.overall_score(evidence(spark, sf_dir))).select("id", "verdict")


@query(f"WITH {_EV} SELECT id, l1_alarm::INT + spectral_alarm::INT + (flagged_ratio > 0.08)::INT + proof_valid::INT + (n_quarantined > 0)::INT AS n_layers_alarmed FROM ev")
def i04_layers_alarmed(spark, sf_dir):
    return verdict.layers_alarmed(evidence(spark, sf_dir)).select("id", "n_layers_alarmed")


@query(f"WITH {_EV} SELECT id FROM ev WHERE {_SCORE} >= 0.35 AND {_SCORE} < 0.65")
def i05_needs_review(spark, sf_dir):
    return verdict.overall_score(evidence(spark, sf_dir)).where(verdict.needs_review(F.col("overall_suspicion"))).select("id")


@query(f"WITH {_EV}, s AS (SELECT id, round(least(1, 0.2 * l1 + 0.2 * l2 + 0.2 * l3 + 0.25 * l4 + 0.1 * l5 + 0.05 * flagged_ratio), 4) AS s FROM ev) SELECT CASE WHEN s >= 0.7 THEN 'CRITICAL' WHEN s >= 0.5 THEN 'MODERATE' WHEN s >= 0.3 THEN 'LOW' ELSE 'NONE' END AS poisoning_level, count(*) AS n FROM s GROUP BY 1")
def i06_fusion_v1(spark, sf_dir):
    return verdict.fusion_v1(evidence(spark, sf_dir).withColumn("drift", F.col("flagged_ratio"))).groupBy("poisoning_level").agg(F.count("*").alias("n"))


@query(f"""WITH {_EV}, a AS (SELECT id, l1 AS s, round(l1 * 100, 1) AS r FROM ev), b AS (SELECT *, round(greatest(0, 100 - r * 1.2), 1) AS q, round(greatest(0, 100 - r * 0.8), 1) AS t FROM a),
c AS (SELECT *, round(q * 0.4 + (100 - r) * 0.35 + t * 0.25, 1) AS o FROM b) SELECT CASE WHEN o < 40 THEN 'F' WHEN o < 55 THEN 'D' WHEN o < 70 THEN 'C' WHEN o < 85 THEN 'B' ELSE 'A' END AS grade, count(*) AS n FROM c GROUP BY 1""")
def i07_trust_grade(spark, sf_dir):
    return verdict.trust_grade(evidence(spark, sf_dir), "l1").groupBy("grade").agg(F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT id, CASE WHEN l1 > 0.65 THEN 'CRITICAL' WHEN l1 > 0.35 THEN 'ELEVATED' WHEN l1 > 0.15 THEN 'GUARDED' ELSE 'NOMINAL' END AS threat_level FROM ev")
def i08_threat_level(spark, sf_dir):
    return evidence(spark, sf_dir).select("id", verdict.threat_level(F.col("l1")).alias("threat_level"))


# ---- response ------------------------------------------------------------------------------------------------------------

_SAMPLES = "sm AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'confirmed' WHEN event_type = 'click' THEN 'suspected' ELSE 'clean' END AS poison_status FROM events)"


def samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "confirmed").when(F.col("event_type") == "click", "suspected").otherwise("clean").alias("poison_status"))


@query(f"WITH {_EV}, v AS (SELECT id, l1, CASE WHEN proof_valid AND l1 >= 0.65 THEN 'CONFIRMED_POISONED' WHEN l1 >= 0.35 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM ev) SELECT CASE WHEN verdict = 'CONFIRMED_POISONED' AND l1 > 0.7 THEN 'quarantine' WHEN verdict = 'SUSPICIOUS' AND l1 > 0.5 THEN 'soft_quarantine' ELSE 'monitor' END AS action, count(*) AS n FROM v GROUP BY 1")
def k01_action(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    v = F.when(F.col("proof_valid") & (F.col("l1") >= 0.65), "CONFIRMED_POISONED").when(F.col("l1") >= 0.35, "SUSPICIOUS").otherwise("CLEAN")
    return ev.select(response.action(F.col("l1"), v).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_SAMPLES} SELECT id FROM sm WHERE poison_status <> 'clean' AND id % 10 <> 0 ORDER BY ts, id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM sm)")
def k02_quarantine(spark, sf_dir):
    s = samples(spark, sf_dir)
    return response.quarantine(s, s.where("id % 10 = 0"), ["ts", "id"]).select("id")


@query(f"WITH {_SAMPLES}, f AS (SELECT id FROM sm WHERE poison_status <> 'clean' ORDER BY ts, id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.025) AS BIGINT)) FROM sm)) SELECT sm.id, CASE WHEN f.id IS NULL THEN 1.0 ELSE 0.1 END AS weight FROM sm LEFT JOIN f ON sm.id = f.id")
def k03_soft_quarantine(spark, sf_dir):
    return response.soft_quarantine(samples(spark, sf_dir), ["ts", "id"]).select("id", "weight")


@query("WITH d AS (SELECT user_id, event_id, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_id, CASE WHEN gap < 3600 THEN 'cooldown' ELSE 'quarantine' END AS action FROM d")
def k04_cooldown(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("event_id", response.cooled_action(F.lit("quarantine"), gap, 3600).alias("action"))


def actions(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("action_id"), F.when(F.col("event_id") % 2 == 0, "quarantine").otherwise("soft_quarantine").alias("action"), (F.col("user_id") % 9).alias("samples_affected"), F.col("ts").alias("timestamp"))


_ACTIONS = "ac AS (SELECT event_id AS action_id, CASE WHEN event_id % 2 = 0 THEN 'quarantine' ELSE 'soft_quarantine' END AS action, user_id % 9 AS samples_affected, ts AS timestamp FROM events WHERE event_type = 'error')"


@query(f"WITH {_ACTIONS} SELECT count(*) AS n_actions, CAST(sum(samples_affected) AS BIGINT) AS total_affected, arg_max(action, (timestamp, action_id)) AS last_action FROM ac")
def k05_status(spark, sf_dir):
    return response.status(actions(spark, sf_dir))


@query(f"WITH {_EV} SELECT id, 'pending' AS status, date_trunc('day', o_orderdate) + INTERVAL '23 hours 59 minutes' AS deadline FROM ev JOIN orders ON id = o_orderkey WHERE {_SCORE} >= 0.35 AND {_SCORE} < 0.65")
def k06_review_queue(spark, sf_dir):
    return response.review_queue(verdict.overall_score(evidence(spark, sf_dir)), F.col("o_orderdate")).select("id", "status", "deadline")


@query("SELECT o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def k07_pending(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("case_id"))
    return response.pending(cases, table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("case_id")))


@query(f"""WITH {_ACTIONS}, u AS (SELECT 'auto_defense' AS type, action, CAST(action_id AS VARCHAR) AS ref, timestamp, CASE WHEN action = 'quarantine' THEN 'high' ELSE 'medium' END AS severity FROM ac
UNION ALL SELECT 'human_decision', 'mark_safe', CAST(event_id AS VARCHAR), ts, 'info' FROM events WHERE event_type = 'click') SELECT * FROM u ORDER BY timestamp DESC, type, ref LIMIT 50""")
def k08_incidents(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("case_id"), F.lit("mark_safe").alias("decision"), F.col("ts").alias("decided_at"))
    return response.incidents(actions(spark, sf_dir), d)


@query("""WITH t AS (SELECT event_type AS attack_type, value > 50 AS detected, value * 10 AS ms, value / 100 AS score FROM events)
SELECT attack_type, count(*) AS total_tests, count(*) FILTER (WHERE detected) AS caught, round(count(*) FILTER (WHERE detected) / count(*) * 100, 1) AS catch_rate_pct, round(avg(ms), 1) AS avg_detection_ms, round(avg(score), 4) AS avg_score FROM t GROUP BY ROLLUP (attack_type)""")
def k09_resilience(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("attack_type"), (F.col("value") > 50).alias("detected"), (F.col("value") * 10).alias("detection_ms"), (F.col("value") / 100).alias("score"))
    return response.resilience(t)


_BOOK = " UNION ALL ".join(f"SELECT '{a}' AS attack_type, '{s}' AS playbook_severity" for a, s, _ in response.PLAYBOOK)


@query(f"WITH b AS ({_BOOK}), t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'backdoor' WHEN 'error' THEN 'label_flip' ELSE 'unknown' END AS attack_type FROM events) SELECT event_id, attack_type, playbook_severity FROM t LEFT JOIN b USING (attack_type)")
def k10_playbook(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "backdoor").when(F.col("event_type") == "error", "label_flip").otherwise("unknown").alias("attack_type"))
    return response.with_playbook(t).select("event_id", "attack_type", "playbook_severity")


# ---- stored results ------------------------------------------------------------------------------------------------------


def stored_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    src = F.when(F.col("o_orderstatus") == "O", "upload").when(F.col("o_orderstatus") == "F", "demo").otherwise("store")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), src.alias("source"), F.col("o_orderpriority").alias("verdict"), F.col("o_orderdate").alias("created_at"))


def scans(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("scan-"), F.col("c_custkey")).alias("id"), F.lit("model").alias("source"), F.col("c_mktsegment").alias("verdict"), F.timestamp_seconds(F.col("c_custkey") * 600_000).alias("created_at"))


_RES = "rs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'O' THEN 'upload' WHEN 'F' THEN 'demo' ELSE 'store' END AS source, o_orderpriority AS verdict, o_orderdate AS created_at FROM orders)"
_SCANS = "sc AS (SELECT 'scan-' || c_custkey AS id, 'model' AS source, c_mktsegment AS verdict, make_timestamp(CAST(c_custkey AS BIGINT) * 600000000000) AS created_at FROM customer)"


@query(f"WITH {_SCANS} SELECT id, source, verdict FROM sc WHERE id = 'scan-7'")
def m01_by_id(spark, sf_dir):
    return results.by_id(stored_results(spark, sf_dir), scans(spark, sf_dir), "scan-7").select("id", "source", "verdict")


@query(f"WITH {_RES} SELECT * FROM rs WHERE source = 'upload' ORDER BY created_at DESC, id DESC LIMIT 1")
def m02_latest(spark, sf_dir):
    return results.latest(stored_results(spark, sf_dir), "upload")


@query(f"WITH {_RES} SELECT * FROM rs ORDER BY created_at DESC, id LIMIT 20")
def m03_history(spark, sf_dir):
    return results.history(stored_results(spark, sf_dir))


@query(f"WITH {_RES}, {_SCANS} SELECT * FROM (SELECT * FROM rs UNION ALL SELECT * FROM sc) ORDER BY created_at DESC, id LIMIT 30")
def m04_merged_history(spark, sf_dir):
    return results.merged_history(stored_results(spark, sf_dir), scans(spark, sf_dir), 30)


@query(f"WITH {_RES} SELECT source, verdict, count(*) AS n FROM rs GROUP BY GROUPING SETS ((source), (verdict))")
def m05_totals(spark, sf_dir):
    return results.totals(stored_results(spark, sf_dir))


@query(f"WITH {_SAMPLES} SELECT id, poison_status FROM sm WHERE poison_status = 'confirmed' ORDER BY ts, id LIMIT 25 OFFSET 50")
def m06_listing(spark, sf_dir):
    return results.listing(samples(spark, sf_dir), "confirmed", ["ts", "id"], 25, 50).select("id", "poison_status")


@query(f"WITH {_SAMPLES} SELECT id FROM sm WHERE id IN (SELECT o_orderkey FROM orders)")
def m07_restricted(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return results.restricted(samples(spark, sf_dir), ids).select("id")


@query(f"WITH {_RES} SELECT * FROM rs ORDER BY CASE source WHEN 'upload' THEN 0 WHEN 'demo' THEN 1 ELSE 2 END, created_at DESC, id LIMIT 1")
def m08_best(spark, sf_dir):
    return results.best(stored_results(spark, sf_dir))


# ---- parameter tables ----------------------------------------------------------------------------------------------------


def parameters(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") % 5).alias("model_id"), F.col("vec_id").alias("unit_id"), F.slice(F.col("embedding").cast("array<double>"), 1, (60 + F.col("vec_id") % 5).cast("int")).alias("params"))


_PAR = "pa AS (SELECT vec_id % 5 AS model_id, vec_id AS unit_id, CAST(embedding[1:60 + vec_id % 5] AS DOUBLE[]) AS params FROM embeddings)"


def _cells(df):
    return df.select("unit_id", F.posexplode("params").alias("i", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {_PAR}, n AS (SELECT *, max(len(params)) OVER (PARTITION BY model_id) AS n FROM pa), i AS (SELECT unit_id, params, unnest(range(n)) AS i FROM n) SELECT unit_id, CAST(i AS INT) AS i, round(coalesce(params[i + 1], 0), 6) AS value FROM i")
def r01_padded(spark, sf_dir):
    return _cells(params.padded(parameters(spark, sf_dir)))


@query(f"""WITH {_PAR}, x AS (SELECT unit_id, CAST(generate_subscripts(params, 1) - 1 AS INT) AS i, unnest(params) AS v FROM pa)
SELECT unit_id, i, CASE (unit_id + i) % 11 WHEN 0 THEN CASE WHEN v > 0 THEN 1000000.0 ELSE -1000000.0 END WHEN 1 THEN 0.0 ELSE round(v, 6) END AS value FROM x""")
def r02_finite(spark, sf_dir):
    """Every eleventh cell is infinite, with its sign, and the one behind it is not a number."""
    place = lambda i: (F.col("unit_id") + i) % 11
    inf = lambda v: F.when(v > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    odd = parameters(spark, sf_dir).withColumn("params", F.transform("params", lambda v, i: F.when(place(i) == 0, inf(v)).when(place(i) == 1, F.lit(float("nan"))).otherwise(v)))
    return _cells(params.finite(odd))


@query()
def r03_unit_sample(spark, sf_dir):
    return params.unit_sample(parameters(spark, sf_dir), 100).select("model_id", "unit_id")


@query(f"WITH {_PAR}, x AS (SELECT model_id, unnest(params) AS x FROM pa) SELECT model_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sigma, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg((abs(x) < 1e-6)::INT), 6) AS sparsity FROM x GROUP BY model_id")
def r04_statistics(spark, sf_dir):
    return rounded(params.statistics(parameters(spark, sf_dir)), "mean", "sigma", "min", "max", "sparsity")



@query()
def r05_parameter_pipeline(spark, sf_dir):
    """Units in batches of 50, 70/30 by unit, then the layers that need no label: shift, spectrum, tails, unsupervised effect. One row."""
    clean = params.finite(params.padded(parameters(spark, sf_dir)))
    n = clean.agg(F.max(F.size("params")).alias("n")).first()["n"] or 1
    names = [f"p{i}" for i in range(n)]
    rows = prep.split_by_order(prep.minmax_scale(params.wide(clean, n), names), ["model_id", "unit_id"]).withColumn("label", F.lit(None).cast("int"))
    rows = tables.stored(rows, "units")
    one = analysis.shift_layer(rows, names).select(F.col("suspicion_score").alias("layer1"), F.col("verdict").alias("layer1_verdict"))
    two = spectral.cluster_analysis_twice(rows.withColumn("activation", F.array(*names)), "activation", names).select("minority_ratio", "inertia_gap", "silhouette")
    scores = ensemble.tail_flags(ensemble.tail_scores(unpivot(rows, names, ["split", "row_rank"]), "row_rank"))
    flagged = tables.stored(rows.join(scores.select("row_rank", F.col("copod_flag").alias("flagged")), "row_rank"), "flagged-units")
    three = flagged.agg(F.count("*").alias("n_units"), F.countDistinct("batch_id").alias("n_batches"), F.avg(F.col("flagged").cast("double")).alias("flagged_ratio"))
    four = causal.unsupervised_effect(flagged, names).select("causal_effect", "proof_valid")
    return one.crossJoin(two).crossJoin(three).crossJoin(four)
