"""Queries over outlier detectors, their vote and the query-pattern test (E); lineitem scaled and split, or vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import ensemble
from tabguard.plans.base import FEATURES, LONG, ORDER, SPLIT, query, table
from tabguard.plans.prep_queries import scaled_split
from tabguard.plans.shift_queries import rounded
from tabguard.sources import tables


def prepared(spark, sf_dir):
    return tables.stored(scaled_split(spark, sf_dir), "prepared")


def reference():
    return F.col("split") == "reference"


_Q = ", ".join(f"quantile_cont({c}, 0.25) FILTER (WHERE split = 'reference') AS a_{c}, quantile_cont({c}, 0.5) FILTER (WHERE split = 'reference') AS m_{c}, quantile_cont({c}, 0.75) FILTER (WHERE split = 'reference') AS b_{c}" for c in FEATURES)
_RS = ", ".join(f"round(({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}" for c in FEATURES)


@query(f"WITH {SPLIT}, q AS (SELECT {_Q} FROM split) SELECT row_rank, {_RS} FROM split, q")
def e01_robust_scale(spark, sf_dir):
    return rounded(ensemble.robust_scale(prepared(spark, sf_dir), FEATURES, reference()), *FEATURES).select("row_rank", *FEATURES)


def _counted(df, flag):
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))


@query()
def e02_isolation_forest(spark, sf_dir):
    return _counted(ensemble.isolation_forest(prepared(spark, sf_dir), FEATURES, ORDER, reference()), "isolation_flag")


@query()
def e03_one_class(spark, sf_dir):
    return _counted(ensemble.one_class(prepared(spark, sf_dir), FEATURES, reference()), "oneclass_flag")


def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(DIMENSIONS)], F.when(F.col("vec_id") % 10 < 7, "reference").otherwise("incoming").alias("split"))


#: Coordinates of an embedding.
DIMENSIONS = 64
_V = [f"v{i}" for i in range(DIMENSIONS)]
_VSQL = "v AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(DIMENSIONS)) + ", CASE WHEN vec_id % 10 < 7 THEN 'reference' ELSE 'incoming' END AS split FROM embeddings)"
_D2 = "(" + " + ".join(f"(a.v{i} - b.v{i}) ** 2" for i in range(DIMENSIONS)) + ")"
_NN = f"nn AS (SELECT a.vec_id AS key, b.vec_id AS other, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS nth FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


@query(f"""WITH {_VSQL}, r AS (SELECT * FROM v WHERE split = 'reference'), mine AS (SELECT a.vec_id AS key, b.vec_id AS other, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS nth FROM v a JOIN r b ON a.vec_id <> b.vec_id QUALIFY nth <= 10),
own AS (SELECT * FROM mine WHERE key % 10 < 7), kd AS (SELECT key, max(d) AS kd FROM own GROUP BY key), lrd AS (SELECT o.key, 1 / (avg(greatest(o.d, k.kd)) + 1e-10) AS lrd FROM own o JOIN kd k ON k.key = o.other GROUP BY o.key)
SELECT m.key, round(avg(l.lrd) * (avg(greatest(m.d, k.kd)) + 1e-10), 6) AS lof FROM mine m JOIN kd k ON k.key = m.other JOIN lrd l ON l.key = m.other GROUP BY m.key""")
def e04_local_outlier_factor(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(ensemble.local_outlier_factor(v, v.where("split = 'reference'"), _V, "vec_id", 10), "lof")


@query(f"WITH {_VSQL}, {_NN} SELECT round(greatest(quantile_cont(d, 0.9), 0.1), 6) AS eps FROM nn WHERE nth = 4")
def e05_estimate_eps(spark, sf_dir):
    return rounded(ensemble.estimate_eps(vectors(spark, sf_dir), _V, "vec_id"), "eps")


@query(f"""WITH {_VSQL}, p AS (SELECT a.vec_id AS key, b.vec_id AS other FROM v a JOIN v b ON {_D2} <= 0.81), c AS (SELECT key FROM p GROUP BY key HAVING count(*) >= 6)
SELECT vec_id AS key, vec_id NOT IN (SELECT key FROM p WHERE other IN (SELECT key FROM c)) AS noise FROM v""")
def e06_density_noise(spark, sf_dir):
    return ensemble.density_noise(vectors(spark, sf_dir), _V, "vec_id", 0.9, 6)


@query(f"""WITH RECURSIVE {_VSQL}, p AS (SELECT a.vec_id AS key, b.vec_id AS other FROM v a JOIN v b ON {_D2} <= 0.81), n AS (SELECT key, count(*) AS n FROM p GROUP BY key), c AS (SELECT key FROM n WHERE n >= 6),
e AS (SELECT key, other FROM p WHERE key IN (FROM c) AND other IN (FROM c)), reach AS (SELECT key, key AS other FROM c UNION SELECT r.key, e.other FROM reach r JOIN e ON e.key = r.other), l AS (SELECT key, min(other) AS cluster FROM reach GROUP BY key),
o AS (SELECT p.key, min(l.cluster) AS cluster FROM p JOIN l ON l.key = p.other WHERE p.key NOT IN (FROM c) GROUP BY p.key)
SELECT n.key, n.n, n.n >= 6 AS core, coalesce(l.cluster, o.cluster) IS NULL AS noise, coalesce(l.cluster, o.cluster) AS cluster FROM n LEFT JOIN l ON l.key = n.key LEFT JOIN o ON o.key = n.key""")
def e06_density_clusters(spark, sf_dir):
    return ensemble.density_clusters(vectors(spark, sf_dir), _V, "vec_id", 0.9, 6)


@query()
def e07_elliptic(spark, sf_dir):
    return _counted(ensemble.elliptic(prepared(spark, sf_dir), FEATURES, reference()), "elliptic_flag")


@query()
def e08_boosted_pu(spark, sf_dir):
    return _counted(ensemble.positive_unlabelled(prepared(spark, sf_dir), FEATURES, ORDER, reference(), "gbt", 100), "gbt_flag")


@query()
def e09_forest_pu(spark, sf_dir):
    return _counted(ensemble.positive_unlabelled(prepared(spark, sf_dir), FEATURES, ORDER, reference(), "rf", 100), "rf_flag")


_COPOD = f"""{LONG}, cc AS (SELECT feature, value, count(*) FILTER (WHERE split = 'reference') AS r FROM long GROUP BY ALL),
cf AS (SELECT feature, value, greatest(1e-9, least(1 - 1e-9, sum(r) OVER (PARTITION BY feature ORDER BY value) / sum(r) OVER (PARTITION BY feature))) AS f FROM cc),
cs AS (SELECT row_rank, sum(-ln(least(f, 1 - f))) AS copod FROM long JOIN cf USING (feature, value) GROUP BY row_rank)"""


def tails(spark, sf_dir):
    return ensemble.tail_scores(unpivot(prepared(spark, sf_dir), FEATURES, ["split", "row_rank"]), "row_rank")


@query(f"WITH {_COPOD} SELECT row_rank, round(copod, 5) AS copod FROM cs")
def e10_tail_scores(spark, sf_dir):
    return rounded(tails(spark, sf_dir), "copod", digits=5)


@query(f"WITH {_COPOD} SELECT count(*) AS n, count(*) FILTER (WHERE copod > q + 1e-9) AS flagged FROM cs, (SELECT quantile_cont(copod, 0.95) AS q FROM cs)")
def e10_tail_flags(spark, sf_dir):
    return ensemble.tail_flags(tails(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if("copod_flag").alias("flagged"))


_FLAGS = ["f1", "f2", "f3", "f4"]
_FSQL = "fl AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS f1, o_orderkey % 4 = 0 AS f2, o_custkey % 2 = 0 AS f3, o_totalprice > 200000 AS f4 FROM orders), vt AS (SELECT *, f1::INT + f2::INT + f3::INT + f4::INT AS votes FROM fl)"


def flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("f1"), (F.col("o_orderkey") % 4 == 0).alias("f2"), (F.col("o_custkey") % 2 == 0).alias("f3"), (F.col("o_totalprice") > 200000).alias("f4"))


@query(f"WITH {_FSQL} SELECT o_orderkey, votes, votes >= 3 AS flagged FROM vt")
def e11_vote(spark, sf_dir):
    return ensemble.vote(flags(spark, sf_dir), _FLAGS).select("o_orderkey", "votes", "flagged")


@query(f"WITH {_FSQL} SELECT count(*) AS n, count(*) FILTER (WHERE votes >= 3) AS flagged_count, round(avg((votes >= 3)::INT), 8) AS flagged_ratio, round(least(1, greatest(0, (avg((votes >= 3)::INT) - 0.05) / 0.3)), 8) AS suspicion_score FROM vt")
def e12_layer_score(spark, sf_dir):
    return rounded(ensemble.layer_score(ensemble.vote(flags(spark, sf_dir), _FLAGS)), "flagged_ratio", "suspicion_score", digits=8)


@query(f"WITH {_FSQL}, u AS (SELECT detector, flag::INT AS flag FROM fl UNPIVOT (flag FOR detector IN (f1, f2, f3, f4))) SELECT detector, CAST(sum(flag) AS BIGINT) AS flagged_count, round(avg(flag), 8) AS flagged_ratio FROM u GROUP BY detector")
def e13_per_detector(spark, sf_dir):
    return rounded(ensemble.per_detector(flags(spark, sf_dir), _FLAGS), "flagged_ratio", digits=8)


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS a, o_custkey::DOUBLE AS b, o_orderkey % 3 = 0 AS f1, o_orderkey % 4 = 0 AS f2 FROM orders), l AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM s)
SELECT o_orderkey, round(0.6 * (-a - a0) / (a1 - a0 + 1e-8) + 0.4 * (-b - b0) / (b1 - b0 + 1e-8), 6) AS ensemble_score, (f1::INT + f2::INT) / 2 AS agreement FROM s, l""")
def e14_weighted_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"), (F.col("o_orderkey") % 3 == 0).alias("f1"), (F.col("o_orderkey") % 4 == 0).alias("f2"))
    return rounded(ensemble.weighted_vote(o, {"a": 0.6, "b": 0.4}, ["f1", "f2"]), "ensemble_score").select("o_orderkey", "ensemble_score", "agreement")


@query()
def e15_bounded_sample(spark, sf_dir):
    return ensemble.bounded_sample(table(spark, sf_dir, "orders"), ["o_orderkey"], 200).select("o_orderkey")


@query(f"WITH {_VSQL}, {_NN} SELECT key, CAST(nth AS INT) AS nth, round(d, 6) AS distance FROM nn WHERE nth <= 3")
def e16_nearest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(ensemble.nearest(v, v, _V, "vec_id", 3), "distance").select("key", "nth", "distance")


@query(f"WITH {_FSQL} SELECT o_orderkey, CASE WHEN votes >= 3 THEN 1.0 ELSE 0.1 END::DOUBLE AS ensemble_score FROM vt")
def e17_ensemble_score(spark, sf_dir):
    return ensemble.vote(flags(spark, sf_dir), _FLAGS).select("o_orderkey", "ensemble_score")


_PQ = ", ".join(f"greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-6) + 1e-9 AS i_{c}, quantile_cont({c}, 0.5) / (greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-6) + 1e-9) AS c_{c}" for c in FEATURES)
_PD = "sqrt(" + " + ".join(f"({c} / i_{c} - c_{c}) ** 2" for c in FEATURES) + ")"
_PAT = f"{SPLIT}, pq AS (SELECT {_PQ} FROM split WHERE split = 'reference'), pd AS (SELECT split, {_PD} AS d FROM split, pq), pr AS (SELECT quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.8) AS p80 FROM pd WHERE split = 'reference')"


@query(f"WITH {_PAT} SELECT round(p25, 5) AS p25, round(p80, 5) AS p80 FROM pr")
def e18_pattern_reference(spark, sf_dir):
    return rounded(ensemble.pattern_reference(prepared(spark, sf_dir), FEATURES, reference()), "p25", "p80", digits=5).select("p25", "p80")


@query(f"WITH {_VSQL} SELECT round(avg((vec_id IN (SELECT a.vec_id FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {_D2} <= 0.0025))::INT), 8) AS near_duplicate_rate FROM v")
def e19_near_duplicate_rate(spark, sf_dir):
    return rounded(ensemble.near_duplicate_rate(vectors(spark, sf_dir), _V, "vec_id"), "near_duplicate_rate", digits=8)


@query(f"WITH {_PAT} SELECT round(avg((d < p25)::INT), 5) AS boundary, round(avg((d > p80)::INT), 5) AS tail FROM pd, pr")
def e20_boundary_and_tail(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return rounded(ensemble.pattern_signals(p, ensemble.pattern_reference(p, FEATURES, reference()), FEATURES), "boundary", "tail", digits=5)


# The operator draws at most 1,000 rows by hash; the tables that SQL checks have fewer.
@query(f"WITH {_VSQL}, d AS (SELECT sqrt({_D2}) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id) SELECT round(stddev_pop(d) / (avg(d) + 1e-9), 6) AS cv FROM d")
def e21_uniformity(spark, sf_dir):
    return rounded(ensemble.uniformity(vectors(spark, sf_dir), _V, "vec_id"), "cv")


@query("""WITH m AS (SELECT o_orderkey, (o_orderkey % 40) / 100.0::DOUBLE AS a, (o_custkey % 50) / 100.0::DOUBLE AS b, (o_orderkey % 90) / 100.0::DOUBLE AS c, (o_custkey % 60) / 100.0::DOUBLE AS d FROM orders)
SELECT o_orderkey, round(least(1, 0.3 * least(a / 0.15, 1) + 0.2 * least(b / 0.15, 1) + 0.3 * greatest(0, 1 - c / 0.5) + 0.2 * least(greatest(0, d - 0.2) / 0.1, 1)), 6) AS suspicion_score FROM m""")
def e23_pattern_score(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    m = o.select("o_orderkey", (k % 40 / 100.0).alias("near_duplicate_rate"), (c % 50 / 100.0).alias("boundary"), (k % 90 / 100.0).alias("cv"), (c % 60 / 100.0).alias("tail"))
    return rounded(ensemble.pattern_score(m), "suspicion_score").select("o_orderkey", "suspicion_score")
