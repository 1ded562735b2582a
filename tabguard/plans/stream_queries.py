"""Queries that run as streams over what their source holds (S); batch SQL checks what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.plans.base import FEATURES, query
from tabguard.plans.ensemble_queries import _PAT, _PD, prepared
from tabguard.plans.forensics_queries import _BAD, _SM, samples
from tabguard.plans.shift_queries import _STEP, BASE, rounded
from tabguard.plans.trust_queries import _DIV, _DRIFT, _TRUST, shares, sims
from tabguard.plans.verdict_queries import evidence
from tabguard.sources import tables
from tabguard.sources.tables import scratch
from tabguard.streaming import keyed, scoring, stream


def as_stream(df, name):
    """``df`` as a stream of files written for it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return stream.read(df.sparkSession, path, 100)


#: Parts that streams with keyed state get, by hash, so in no order of time.
PARTS = 4


@query(f"WITH RECURSIVE {_TRUST}{_DIV} SELECT client_id, round, round(trust, 6) AS trust, quarantined, round(divergence, 6) AS divergence, divergence > 0.7 AS fingerprint_alarm FROM hist JOIN div USING (client_id, round)")
def s01_trust_stream(spark, sf_dir):
    """Rounds are minutes; the delay is that of the whole table, as its rows come in no order."""
    s = sims(spark, sf_dir).select("client_id", F.col("round").cast("long").alias("round"), "sim", "gradient", F.timestamp_seconds((F.col("round") + 1) * 60).alias("at"))
    s = tables.stored(s, "rounds")
    last = s.agg(F.max("round").alias("m"), F.min("client_id").alias("c")).first()
    minutes = (last["m"] or 0) + 2
    closing = spark.range(1).select(F.lit(last["c"]).cast("long").alias("client_id"), F.lit(None).cast("long").alias("round"), F.lit(0.0).alias("sim"), F.array().cast("array<double>").alias("gradient"), F.timestamp_seconds(F.lit(minutes * 240)).alias("at"))
    out = keyed.driven(keyed.dealt(s, PARTS, "client_id", "round"), lambda x: keyed.trust_states(x, f"{minutes} minutes"), closing, "trust")
    return rounded(out, "trust", "divergence")


@query(f"WITH {_DRIFT} SELECT batch, round(s, 6) AS step_drift, round(c, 6) AS cumulative_drift FROM dd")
def s02_drift_stream(spark, sf_dir):
    out = stream.drift_per_batch(as_stream(shares(spark, sf_dir), "shares"), FEATURES)
    return rounded(out, "step_drift", "cumulative_drift").select("batch", "step_drift", "cumulative_drift")


@query(f"WITH {_SM} SELECT date_trunc('hour', ingested_at) AS hour, count(*) FILTER (WHERE {_BAD}) AS poison_count, count(*) FILTER (WHERE NOT {_BAD}) AS clean_count FROM sm GROUP BY 1")
def s03_hourly_counts(spark, sf_dir):
    """The delay is that of the whole table, as its rows come in no order; a last row of no status closes its hours."""
    s = tables.stored(samples(spark, sf_dir).select("ingested_at", "poison_status"), "samples")
    span = s.agg((F.max("ingested_at").cast("double") - F.min("ingested_at").cast("double")).alias("d"), F.max("ingested_at").alias("m")).first()
    hours = int((span["d"] or 0) // 3600) + 2
    closing = spark.range(1).select((F.lit(span["m"]).cast("timestamp") + F.make_interval(hours=F.lit(2 * hours))).alias("ingested_at"), F.lit(None).cast("string").alias("poison_status"))
    parts = [part.select(*closing.columns) for part in keyed.dealt(s, PARTS, "ingested_at")]
    return keyed.driven(parts, lambda x: stream.hourly_counts(x, f"{hours} hours"), closing, "hourly")


_POINTS = "[" + ", ".join(str(x) for x in scoring.GRID) + "]"
_SCORED = f"""{BASE}, grid AS (SELECT feature, quantile_cont(value, {_POINTS}) AS g FROM long WHERE split = 'reference' GROUP BY feature),
win AS (SELECT row_rank, CAST(floor(epoch(l_shipdate) / 2592000) AS BIGINT) AS w FROM split WHERE split = 'incoming'),
pl0 AS (SELECT l.split, win.w, l.feature, l.value, p1, p99, iqr, g, len(list_filter(g, lambda c: l.value > c + 1e-9)) AS place, CAST(least(floor((l.value - p1) / {_STEP}), 19) AS INT) AS i FROM long l JOIN base USING (feature) JOIN grid USING (feature) LEFT JOIN win USING (row_rank)),
pl AS (SELECT *, CASE WHEN p99 > p1 AND value BETWEEN p1 AND p99 THEN CASE WHEN value < p1 + i * {_STEP} THEN i - 1 WHEN i < 19 AND value >= (CASE WHEN i + 1 = 20 THEN p99 ELSE p1 + (i + 1) * {_STEP} END) THEN i + 1 ELSE i END END AS bin FROM pl0),
wf AS (SELECT w, feature, count(*) AS n, avg(CASE WHEN bin IS NULL THEN 1 ELSE 0 END) AS out_of_range, any_value(p99 > p1) AS ok, any_value(iqr) AS iqr, any_value(g) AS g FROM pl WHERE w IS NOT NULL GROUP BY ALL),
rb AS (SELECT feature, bin, count(*) AS c FROM pl WHERE split = 'reference' AND bin IS NOT NULL GROUP BY ALL), ib AS (SELECT w, feature, bin, count(*) AS c FROM pl WHERE w IS NOT NULL AND bin IS NOT NULL GROUP BY ALL),
kb AS (SELECT wf.w, wf.feature, ok, coalesce(ib.c, 0) + 1e-10 AS p, coalesce(rb.c, 0) + 1e-10 AS q FROM wf CROSS JOIN (SELECT unnest(range(20)) AS bin) x LEFT JOIN ib ON ib.w = wf.w AND ib.feature = wf.feature AND ib.bin = x.bin LEFT JOIN rb ON rb.feature = wf.feature AND rb.bin = x.bin),
kn AS (SELECT w, feature, ok, p / sum(p) OVER (PARTITION BY w, feature) AS p, q / sum(q) OVER (PARTITION BY w, feature) AS q FROM kb), kw AS (SELECT w, feature, CASE WHEN bool_and(ok) THEN sum(p * ln(p / q)) ELSE 0 END AS kl FROM kn GROUP BY ALL),
pt AS (SELECT unnest(range({len(scoring.GRID)})) AS j), rg AS (SELECT feature, j AS i, count(*) FILTER (WHERE place <= j) / count(*) AS f FROM pl CROSS JOIN pt WHERE split = 'reference' GROUP BY ALL), ig AS (SELECT w, feature, j AS i, count(*) FILTER (WHERE place <= j) / count(*) AS f FROM pl, pt WHERE w IS NOT NULL GROUP BY ALL),
ww AS (SELECT wf.w, wf.feature, sum(abs(ig.f - rg.f) * (g[ig.i + 2] - g[ig.i + 1])) AS w1 FROM wf JOIN ig ON ig.w = wf.w AND ig.feature = wf.feature JOIN rg ON rg.feature = wf.feature AND rg.i = ig.i WHERE ig.i < {len(scoring.GRID) - 1} GROUP BY ALL),
tt AS (SELECT w, pl.feature, avg(-ln(least(x, 1 - x))) AS tail FROM (SELECT w, pl.feature, greatest(1e-9, least(1 - 1e-9, coalesce(rg.f, 1))) AS x FROM pl LEFT JOIN rg ON rg.feature = pl.feature AND rg.i = place WHERE w IS NOT NULL) pl GROUP BY ALL)"""


def incoming_stream(spark, sf_dir):
    """A baseline of the reference part, written and read again, and the rest as a stream with days as event time."""
    p = prepared(spark, sf_dir)
    path = scratch(spark, "baseline")
    scoring.fit(p.where("split = 'reference'"), FEATURES).save(path)
    rows = p.where("split = 'incoming'").select(*FEATURES, F.timestamp_seconds(F.unix_date(F.to_date("l_shipdate")) * 86400).alias("at"))
    return scoring.scored(as_stream(rows, "incoming"), scoring.Baseline.load(spark, path, FEATURES), "at", "30 days").withColumn("w", F.floor(F.unix_timestamp("w") / 2592000)), scoring.Baseline.load(spark, path, FEATURES)


@query(f"WITH {_SCORED} SELECT w, feature, n, round(kl, 6) AS kl, round(w1, 6) AS w1, round(w1 / iqr, 6) AS w1_norm, round(tail, 6) AS tail, round(out_of_range, 6) AS out_of_range FROM wf JOIN kw USING (w, feature) JOIN ww USING (w, feature) JOIN tt USING (w, feature)")
def s04_scored_stream(spark, sf_dir):
    merged, base = incoming_stream(spark, sf_dir)
    return rounded(scoring.by_feature(merged, base), "kl", "w1", "w1_norm", "tail", "out_of_range")


@query(f"WITH {_PAT} SELECT CAST(floor(epoch(l_shipdate) / 2592000) AS BIGINT) AS w, count(*) AS n, round(avg((d < p25)::INT), 6) AS boundary, round(avg((d > p80)::INT), 6) AS tail FROM (SELECT *, {_PD} AS d FROM split, pq WHERE split = 'incoming') x, pr GROUP BY 1")
def s04_pattern_stream(spark, sf_dir):
    merged, _ = incoming_stream(spark, sf_dir)
    return rounded(scoring.by_row(merged), "boundary", "tail")


@query("""WITH RECURSIVE e AS (SELECT event_type AS segment, epoch_us(ts) AS us FROM events),
nxt AS MATERIALIZED (SELECT DISTINCT segment, us, min(us) OVER (PARTITION BY segment ORDER BY us RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM e),
chain AS (SELECT segment, min(us) AS us FROM e GROUP BY segment UNION ALL SELECT n.segment, n.next_us FROM chain c JOIN nxt n ON c.segment = n.segment AND c.us = n.us WHERE n.next_us IS NOT NULL),
q AS (SELECT segment, count(*) AS n FROM chain GROUP BY segment), t AS (SELECT segment, count(*) AS n FROM e GROUP BY segment)
SELECT segment, 'quarantine' AS action, n FROM q UNION ALL SELECT segment, 'cooldown', t.n - q.n FROM t JOIN q USING (segment) WHERE t.n > q.n""")
def s05_cooldown_stream(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("segment"), F.col("ts").cast("timestamp").alias("at"))
    e = tables.stored(e.groupBy("segment", "at").agg(F.count("*").alias("n")).select("segment", F.col("at").cast("double").alias("seconds"), "n", "at"), "decisions")
    span = e.agg((F.max("seconds") - F.min("seconds")).alias("d"), F.max("seconds").alias("m"), F.min("segment").alias("s")).first()
    seconds = int(span["d"] or 0) + 1
    closing = spark.range(1).select(F.lit(span["s"]).cast("string").alias("segment"), F.lit(None).cast("double").alias("seconds"), F.lit(0).cast("long").alias("n"), F.timestamp_seconds(F.lit((span["m"] or 0.0) + 2 * seconds)).alias("at"))
    out = keyed.driven(keyed.dealt(e, PARTS, "segment", "seconds"), lambda x: keyed.cooldown_states(x, 3600, f"{seconds} seconds"), closing, "actions")
    return out.groupBy("segment", "action").agg(F.sum("n").alias("n"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS s, o_orderkey % 3 = 0 AND o_totalprice / 500000 >= 0.65 AS bad FROM orders)
SELECT 'sample_analyzed' AS event, count(*) AS n FROM v UNION ALL SELECT 'attack_confirmed', count(*) FILTER (WHERE bad) FROM v UNION ALL SELECT 'defense_triggered', count(*) FILTER (WHERE bad AND s > 0.7) FROM v UNION ALL SELECT 'human_review_required', count(*) FILTER (WHERE s >= 0.35 AND s < 0.65) FROM v""")
def s06_event_feed(spark, sf_dir):
    v = evidence(spark, sf_dir).select("id", F.col("l1").alias("overall_suspicion"), F.when(F.col("proof_valid") & (F.col("l1") >= 0.65), "CONFIRMED_POISONED").otherwise("CLEAN").alias("verdict"))
    return stream.run(stream.event_feed(as_stream(v, "verdicts")), "feed").groupBy("event").agg(F.count("*").alias("n"))


