"""Layer 5: trust of federated clients from their gradients.

Frames have client_id, round, gradient (array<double>) and one row per client and round; the global gradient is an
array in a one-row frame, or one row per round. A null gradient counts as zero; clients without rows do not appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import clip, cosine

# Start, weights and thresholds of trust.
START, WARM, ACTIVE, WARM_ROUNDS = 0.5, 0.30, 0.70, 3
QUARANTINE, RELEASE, SUSPICIOUS, TRUSTED = 0.30, 0.45, 0.50, 0.70
DIVERGENCE = 0.70


def similarity(clients: DataFrame, global_gradient: DataFrame, on: list[str] = []) -> DataFrame:  # noqa: B006
    """``clients`` with cosine to ``global_gradient`` and sim = (cosine + 1) / 2."""
    zero = F.array().cast("array<double>")
    both = clients.join(global_gradient, on) if on else clients.crossJoin(F.broadcast(global_gradient))
    return both.withColumn("cosine", cosine(F.coalesce("gradient", zero), F.coalesce("global_gradient", zero))).withColumn("sim", clip((F.col("cosine") + 1) / 2))


def mean_gradient(clients: DataFrame, by: list[str] = ["round"]) -> DataFrame:  # noqa: B006
    """The sample-weighted mean gradient of each group (of equal weights without n_samples)."""
    w = F.col("n_samples").cast("double") if "n_samples" in clients.columns else F.lit(1.0)
    cells = clients.select(*by, w.alias("w"), F.posexplode("gradient").alias("i", "g"))
    means = cells.groupBy(*by, "i").agg((F.sum(F.col("g") * F.col("w")) / F.sum("w")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("global_gradient"))


def trust_history(sims: DataFrame, warm: float = WARM, active: float = ACTIVE, start: float = START, permanent: bool = False) -> DataFrame:
    """client_id, round, nth, sim, trust, quarantined: the moving average of sim over each client's rounds in order.

    One row per client folds its rounds; a client's rounds must fit one row (the streaming form has no such limit).
    """
    step = "struct<round:bigint,nth:int,sim:double,trust:double,quarantined:boolean>"

    def fold(acc: Column, x: Column) -> Column:
        n = F.size(acc["out"]) + 1
        a = F.when(n <= WARM_ROUNDS, warm).otherwise(active)
        t = a * x["sim"] + (1 - a) * acc["trust"]
        held = acc["quarantined"] & (F.lit(True) if permanent else (t < RELEASE))
        q = held | ((t < QUARANTINE) & (n >= WARM_ROUNDS))
        row = F.struct(x["round"].cast("bigint").alias("round"), n.cast("int").alias("nth"), x["sim"].alias("sim"), t.alias("trust"), q.alias("quarantined"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), t.alias("trust"), q.alias("quarantined"))

    first = F.struct(F.array().cast(f"array<{step}>").alias("out"), F.lit(start).cast("double").alias("trust"), F.lit(False).alias("quarantined"))
    rows = sims.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("round", "sim"))).alias("rounds"))
    return rows.select("client_id", F.explode(F.aggregate("rounds", first, fold)["out"]).alias("r")).select("client_id", "r.*")


def with_status(history: DataFrame) -> DataFrame:
    s = F.when(F.col("quarantined"), "QUARANTINED").when(F.col("trust") < SUSPICIOUS, "SUSPICIOUS").when(F.col("trust") < TRUSTED, "ACCEPTABLE").otherwise("TRUSTED")
    return history.withColumn("status", s)


def divergence(clients: DataFrame) -> DataFrame:
    """client_id, round, divergence (1 - cosine) / 2 from the client's own mean of earlier rounds, and its alarm.

    0 during the first rounds.
    """
    order = Window.partitionBy("client_id").orderBy("round")
    numbered = clients.withColumn("nth", F.row_number().over(order))
    cells = numbered.select("client_id", "round", "nth", F.posexplode("gradient").alias("i", "g"))
    before = Window.partitionBy("client_id", "i").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("m", F.avg("g").over(before))
    out = cells.groupBy("client_id", "round", "nth").agg(F.sum(F.col("g") * F.col("m")).alias("gm"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("gg"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mm"))
    cos = F.when((F.col("gg") < 1e-9) | (F.col("mm") < 1e-9), 0.0).otherwise(F.col("gm") / (F.col("gg") * F.col("mm")))
    d = F.when(F.col("nth") > WARM_ROUNDS, (1 - cos) / 2).otherwise(0.0)
    return out.select("client_id", "round", d.alias("divergence"), (d > DIVERGENCE).alias("fingerprint_alarm"))


def snapshot(history: DataFrame) -> DataFrame:
    """The last round of every client."""
    w = Window.partitionBy("client_id").orderBy(F.desc("round"))
    return history.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def layer_result(last: DataFrame) -> DataFrame:
    """One row: suspicion, counts, mean trust and sorted client lists, from a snapshot with fingerprint_alarm."""
    low, sus = F.col("trust") < QUARANTINE, F.col("trust") < SUSPICIOUS
    out = last.agg(F.count("*").alias("n_clients"), F.count_if(low).alias("n_quarantined"), F.count_if(sus).alias("n_suspicious"), F.count_if("fingerprint_alarm").alias("n_fingerprint_alarm"), F.avg("trust").alias("avg_trust"), F.array_sort(F.collect_list(F.when(low, F.col("client_id")))).alias("quarantined_clients"), F.array_sort(F.collect_list(F.when(sus & ~low, F.col("client_id")))).alias("suspicious_clients"))
    raw = (F.col("n_quarantined") * 2.0 + F.col("n_suspicious") * 0.5 + F.col("n_fingerprint_alarm") * 0.3) / F.col("n_clients") / 2.8
    return out.withColumn("suspicion_score", F.coalesce(clip(raw), F.lit(0.0)))


def replay(clients: DataFrame, rounds: int = 5) -> DataFrame:
    """Each client's gradient in ``rounds`` equal rounds."""
    return clients.drop("round").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


