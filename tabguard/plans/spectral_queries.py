"""Queries over spectral signatures (D) and robust distances (C7-C9); vectors are the activations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import linalg, spectral
from tabguard.plans.base import FEATURES, query, table
from tabguard.plans.ensemble_queries import prepared, reference
from tabguard.plans.shift_queries import rounded


def embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("activation"), "label")


_COV = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES))


@query(_COV)
def c07_covariance(spark, sf_dir):
    cov, _, _ = linalg.covariance(table(spark, sf_dir, "lineitem").select(*FEATURES))
    rows = [(i, j, round(float(cov[i, j]), 4)) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double")


@query()
def c08_robust_covariance(spark, sf_dir):
    cov, mean = linalg.robust_covariance(prepared(spark, sf_dir).where(reference()), FEATURES)
    return spark.createDataFrame([(c, float(mean[i]), [float(x) for x in cov[i]]) for i, c in enumerate(FEATURES)], "feature string, centre double, covariance array<double>")


@query()
def c09_mahalanobis(spark, sf_dir):
    return linalg.mahalanobis_of_medians(prepared(spark, sf_dir), FEATURES)


@query()
def d01_top_direction(spark, sf_dir):
    way = spectral.top_direction(prepared(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(c, float(x)) for c, x in zip(FEATURES, way, strict=True)], "feature string, weight double")


@query()
def d02_activations(spark, sf_dir):
    return spectral.activations(prepared(spark, sf_dir), FEATURES, "label").select("row_rank", "activation")


@query("WITH x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, unnest(CAST(embedding AS DOUBLE[])) * (1 + vec_id % 3) AS v FROM embeddings) SELECT vec_id, i, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-9), 6) AS value FROM x")
def d04_normalised(spark, sf_dir):
    e = embedded(spark, sf_dir).withColumn("activation", F.transform("activation", lambda v: v * (1 + F.col("vec_id") % 3)))
    return e.select("vec_id", F.posexplode(spectral.normalised(F.col("activation"))).alias("i", "value")).withColumn("value", F.round("value", 6))


@query()
def d05_plane(spark, sf_dir):
    return spectral.projected(embedded(spark, sf_dir), "activation").select("vec_id", "plane")


@query()
def d06_spectrum(spark, sf_dir):
    return spectral.spectrum(embedded(spark, sf_dir))


@query("SELECT o_orderkey, round(2.5 * sqrt((o_custkey % 100) / 8), 8) AS threshold FROM orders")
def d07_gap_threshold(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(spectral.gap_threshold(F.col("o_custkey") % 100), 8).alias("threshold"))


@query()
def d08_cluster_analysis(spark, sf_dir):
    return spectral.cluster_analysis(spectral.projected(embedded(spark, sf_dir), "activation"))


@query("""WITH p AS (SELECT vec_id, label % 2 AS cluster, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.vec_id, a.cluster, b.cluster AS other, sum(list_distance(a.e, b.e)) / greatest(count(*) - CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END, 1) AS m FROM p a CROSS JOIN p b GROUP BY a.vec_id, a.cluster, b.cluster),
s AS (SELECT vec_id, cluster, max(m) FILTER (WHERE cluster = other) AS a, min(m) FILTER (WHERE cluster <> other) AS b FROM d GROUP BY vec_id, cluster)
SELECT cluster, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s GROUP BY cluster""")
def d10_silhouette(spark, sf_dir):
    """By the parity of the label, over whole embeddings."""
    e = embedded(spark, sf_dir).where("label IS NOT NULL").withColumn("cluster", F.col("label") % 2)
    s = spectral.silhouettes(e, "activation")
    return rounded(s.groupBy("cluster").agg(F.sum("n").alias("n"), (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette")), "silhouette")


@query()
def d11_second_pass(spark, sf_dir):
    """Activations are the whole embeddings, features their first eight coordinates."""
    v = embedded(spark, sf_dir)
    names = [f"x{i}" for i in range(8)]
    return spectral.cluster_analysis_twice(v.select("vec_id", "activation", *[F.get("activation", F.lit(i)).alias(c) for i, c in enumerate(names)]), "activation", names)


@query("""WITH p AS (SELECT label % 2 AS cluster, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT cluster, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p GROUP BY cluster),
d AS (SELECT p.cluster, any_value(n) AS n, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS t FROM p JOIN m ON p.cluster = m.cluster GROUP BY p.cluster)
SELECT min(n) AS minority_count, round(min(n) / sum(n), 8) AS minority_ratio, round(arg_min(t, (n, cluster)), 6) AS tightness FROM d""")
def d09_cluster_measures(spark, sf_dir):
    e = embedded(spark, sf_dir).select((F.col("label") % 2).alias("cluster"), F.slice("activation", 1, 2).alias("plane"))
    return rounded(rounded(spectral.cluster_measures(e), "minority_ratio", digits=8), "tightness")


@query("""WITH m AS (SELECT o_orderkey, (o_orderkey % 60) / 10.0::DOUBLE AS g, (o_custkey % 40) / 100.0::DOUBLE AS r, o_orderkey % 9 AS k, (o_custkey % 90) / 100.0::DOUBLE AS t, (o_orderkey % 20) / 100.0::DOUBLE AS i, (o_custkey % 50) / 100.0::DOUBLE AS s FROM orders),
f AS (SELECT *, (g > 2.5)::INT + (r < 0.15 AND i > 0.08 AND k >= 3)::INT + (t < 0.5 AND k >= 3)::INT + (s > 0.2)::INT AS fired, 0.35 / (1 + exp(-(g - 2.5) / 2 * 3)) + 0.25 / (1 + exp(-(0.15 - r) / 0.1 * 3)) + 0.25 / (1 + exp(-(0.5 - t) / 0.3 * 3)) + 0.15 / (1 + exp(-(s - 0.2) / 0.2 * 3)) AS w FROM m)
SELECT o_orderkey, fired AS signals_fired, round(CASE WHEN fired = 4 THEN least(1, w) WHEN fired = 3 THEN least(0.5, greatest(0.15, w * 0.5)) ELSE least(fired * 0.1, 0.35) END, 6) AS suspicion_score FROM f""")
def d12_fused(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    m = o.select("o_orderkey", (k % 60 / 10.0).alias("relative_gap"), F.lit(2.5).alias("gap_threshold"), (c % 40 / 100.0).alias("minority_ratio"), (k % 9).alias("minority_count"), (c % 90 / 100.0).alias("tightness"), (k % 20 / 100.0).alias("inertia_gap"), (c % 50 / 100.0).alias("silhouette"))
    return rounded(spectral.fused(m), "suspicion_score").select("o_orderkey", "signals_fired", "suspicion_score")


@query()
def d13_suspicious_members(spark, sf_dir):
    c = spectral.clusters(spectral.projected(embedded(spark, sf_dir), "activation"))
    return spectral.suspicious_members(c, ["vec_id"]).select("vec_id", "cluster")


@query()
def d13_cluster_profile(spark, sf_dir):
    return spectral.cluster_profile(embedded(spark, sf_dir))
