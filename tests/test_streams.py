"""Streams against their batch twins, with rows that arrive in no order over many micro-batches."""

import numpy as np
from pyspark.sql import functions as F

from tabguard.operators import trust
from tabguard.streaming import keyed, stream


def test_trust_does_not_depend_on_arrival(spark):
    r = np.random.default_rng(8)
    rows = [(c, k, float(r.random() ** (1 + 3 * (c == 2))), [float(x) for x in r.normal(0, 1, 3) + (c != 1)]) for c in range(5) for k in range(25) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "client_id long, round long, sim double, gradient array<double>")
    want = {(x["client_id"], x["round"]): (x["trust"], x["quarantined"]) for x in trust.trust_history(df).collect()}
    far = {(x["client_id"], x["round"]): (x["divergence"], x["fingerprint_alarm"]) for x in trust.divergence(df).collect()}
    timed = df.withColumn("at", F.timestamp_seconds((F.col("round") + 1) * 60))
    closing = spark.range(1).select(F.lit(0).cast("long").alias("client_id"), F.lit(None).cast("long").alias("round"), F.lit(0.0).alias("sim"), F.array().cast("array<double>").alias("gradient"), F.timestamp_seconds(F.lit(10**6)).alias("at"))
    got = keyed.driven(keyed.dealt(timed, 4, "client_id", "round"), lambda s: keyed.trust_states(s, "1 hour"), closing, "trust").collect()
    assert len(got) == len(rows)
    for x in got:
        k = x["client_id"], x["round"]
        assert abs(x["trust"] - want[k][0]) < 1e-9 and x["quarantined"] == want[k][1]
        assert abs(x["divergence"] - far[k][0]) < 1e-9 and x["fingerprint_alarm"] == far[k][1]
    assert any(x["quarantined"] for x in got)


def test_cooldown_and_late_rows(spark):
    r = np.random.default_rng(9)
    times = sorted(float(t) for t in r.integers(0, 5000, 150))
    last, want = None, 0
    for t in times:
        if last is None or t - last >= 300:
            last, want = t, want + 1
    schema = "segment string, seconds double, n long, at timestamp"
    make = lambda ts: spark.createDataFrame([("a", t, 1) for t in ts], "segment string, seconds double, n long").withColumn("at", F.timestamp_seconds("seconds"))
    closing = spark.createDataFrame([("a", None, 0)], "segment string, seconds double, n long").withColumn("at", F.timestamp_seconds(F.lit(10**6)))
    assert closing.schema.simpleString() == make([1.0]).schema.simpleString() and schema.count(",") == 3
    mixed = [times[i] for i in r.permutation(len(times))]
    got = keyed.driven([make(mixed[:50]), make(mixed[50:100]), make(mixed[100:])], lambda s: keyed.cooldown_states(s, 300, "2 hours"), closing, "acts").collect()
    assert sum(x["n"] for x in got) == 150 and sum(x["n"] for x in got if x["action"] == "quarantine") == want
    # A row that is behind the watermark is left out: 5,000 s came first, with a delay of 10 s.
    got = keyed.driven([make([5000.0]), make([5001.0]), make([100.0, 6000.0])], lambda s: keyed.cooldown_states(s, 300, "10 seconds"), closing, "late").collect()
    assert sorted((x["at"], x["action"]) for x in got) == [(5000.0, "quarantine"), (5001.0, "cooldown"), (6000.0, "quarantine")]


def test_hours_are_given_once_and_late_rows_left_out(spark):
    make = lambda minutes: spark.createDataFrame([(60.0 * m, "confirmed" if m % 3 == 0 else "clean") for m in minutes], "s double, poison_status string").select(F.timestamp_seconds("s").alias("ingested_at"), "poison_status")
    closing = spark.range(1).select(F.timestamp_seconds(F.lit(10**6)).alias("ingested_at"), F.lit(None).cast("string").alias("poison_status"))
    got = {x["hour"].timestamp(): (x["poison_count"], x["clean_count"]) for x in keyed.driven([make([70, 130, 61]), make([119, 250]), make([66, 125, 190])], lambda s: stream.hourly_counts(s, "1 hour"), closing, "hours").collect()}
    # Minute 250 came in the second batch, so hours that ended by minute 190 are closed in the third: 66 and 125 are late.
    assert got == {3600.0: (0, 3), 7200.0: (0, 1), 10800.0: (0, 1), 14400.0: (0, 1)}
