"""Queries over the causal test and fingerprints (F): orders with labels, some of them flagged."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import causal
from tabguard.operators.ranks import with_count, with_rank
from tabguard.plans.base import query, table
from tabguard.plans.shift_queries import rounded
from tabguard.sources import tables

_X = ["a", "b", "c"]
_OSQL = """o AS (SELECT o_orderkey, o_totalprice / 100000 AS a, (o_custkey % 100) / 50.0::DOUBLE AS b, (o_orderkey % 17) / 10.0::DOUBLE AS c, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label, o_orderkey % 9 = 0 AS flagged FROM orders)"""


def labelled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("a"), (F.col("o_custkey") % 100 / 50.0).alias("b"), (F.col("o_orderkey") % 17 / 10.0).alias("c"), (F.col("o_totalprice") > 250000).cast("int").alias("label"), (F.col("o_orderkey") % 9 == 0).alias("flagged"))


def flipped(spark, sf_dir):
    """The same rows with the labels of the flagged ones turned."""
    return labelled(spark, sf_dir).withColumn("label", F.when(F.col("flagged"), 1 - F.col("label")).otherwise(F.col("label")))


@query(f"WITH {_OSQL}, k AS (SELECT least(3, min(n)) AS k FROM (SELECT count(*) AS n FROM o GROUP BY label)), r AS (SELECT label, row_number() OVER (ORDER BY label, o_orderkey) - 1 AS nth FROM o) SELECT CAST(nth % k AS INT) AS _fold, label, count(*) AS n FROM r, k GROUP BY ALL")
def f01_folds(spark, sf_dir):
    return causal.stratified_fold(labelled(spark, sf_dir), ["o_orderkey"], "label").groupBy("_fold", "label").agg(F.count("*").alias("n"))


@query()
def f02_logistic_effect(spark, sf_dir):
    return causal.replicates(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], 0, 0)


@query()
def f03_forest_effect(spark, sf_dir):
    return causal.tree_effect(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], "rf", 50)


@query()
def f04_boosted_effect(spark, sf_dir):
    return causal.tree_effect(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], "gbt", 50)


@query()
def f07_replicates(spark, sf_dir):
    return causal.replicates(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"])


@query()
def f10_proof(spark, sf_dir):
    reps = tables.stored(causal.replicates(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"]))
    lr = reps.where("kind = 'full'").first()["effect"]
    rf = causal.tree_effect(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], "rf", 50).first()["effect"]
    gbt = causal.tree_effect(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], "gbt", 50).first()["effect"]
    return causal.proof(reps, [lr, rf, gbt])


@query("WITH x AS (SELECT o_orderkey, 0.5 + (o_custkey % 50) / 100.0::DOUBLE AS acc, o_orderkey % 2 = 0 AS ok, unnest([30, 60, 90]) AS days FROM orders) SELECT o_orderkey, days, CASE WHEN ok THEN round(0.5 + greatest(acc - 0.5, 0) * 0.7 ** (days // 30) + 1e-9, 4) ELSE acc END AS projected FROM x")
def f11_degradation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (0.5 + F.col("o_custkey") % 50 / 100.0).alias("accuracy"), (F.col("o_orderkey") % 2 == 0).alias("proof_valid"))
    return causal.degradation(o).select("o_orderkey", "days", "projected")


@query()
def f13_inertia_ratio(spark, sf_dir):
    return causal.inertia_ratio(labelled(spark, sf_dir), _X)


@query()
def f19_row_effects(spark, sf_dir):
    return causal.row_effects(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"])


@query()
def f20_shuffled_placebo(spark, sf_dir):
    return causal.shuffled_placebo(causal.replicates(flipped(spark, sf_dir), _X, "label", "flagged", ["o_orderkey"], 0))


_Z = lambda c: f"abs(avg({c}) FILTER (WHERE flagged) - avg({c}) FILTER (WHERE NOT flagged)) / (stddev_pop({c}) FILTER (WHERE NOT flagged) + 1e-9)"


@query(f"WITH {_OSQL} SELECT round(abs(avg(label) FILTER (WHERE flagged) - avg(label) FILTER (WHERE NOT flagged)), 6) AS label_delta, round(({_Z('a')} + {_Z('b')} + {_Z('c')}) / 3, 6) AS mean_feature_z, ({_Z('a')} > 2)::INT + ({_Z('b')} > 2)::INT + ({_Z('c')} > 2)::INT AS n_shifted FROM o")
def f12_label_and_shift(spark, sf_dir):
    return rounded(causal.label_and_shift(labelled(spark, sf_dir), _X), "label_delta", "mean_feature_z")


@query(f"""WITH {_OSQL}, s AS (SELECT flagged, CASE WHEN flagged AND o_orderkey % 2 = 0 THEN 9.99 ELSE b END AS b, c FROM o), u AS (SELECT flagged, feature, round(value, 2) AS value FROM s UNPIVOT (value FOR feature IN (b, c))),
n AS (SELECT count(*) FILTER (WHERE flagged) AS nf, count(*) FILTER (WHERE NOT flagged) AS nc FROM s), k AS (SELECT feature, value, count(*) FILTER (WHERE flagged) / any_value(nf) AS ff, count(*) FILTER (WHERE NOT flagged) / any_value(nc) AS cf FROM u, n GROUP BY ALL)
SELECT feature, value, round(ff, 6) AS flagged_freq, round(cf, 6) AS clean_freq FROM k WHERE ff > 0.05 AND (cf < 1e-6 OR ff / cf >= 3)""")
def f14_value_spikes(spark, sf_dir):
    s = labelled(spark, sf_dir).withColumn("b", F.when(F.col("flagged") & (F.col("o_orderkey") % 2 == 0), 9.99).otherwise(F.col("b")))
    return rounded(causal.value_spikes(s, ["b", "c"], top=None), "flagged_freq", "clean_freq").drop("lift")


@query(f"""WITH {_OSQL}, f AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM o WHERE flagged), z AS (SELECT *, greatest(n // 5, 4) AS size FROM f),
b AS (SELECT r // size AS blk, (var_pop(a) + var_pop(b) + var_pop(c)) / 3 AS v FROM z WHERE (r // size) * size < n - size GROUP BY 1)
SELECT round(1 - (SELECT avg(v) FROM b) / ((var_pop(a) + var_pop(b) + var_pop(c)) / 3), 6) AS homogeneity FROM f""")
def f16_block_homogeneity(spark, sf_dir):
    f = with_count(with_rank(labelled(spark, sf_dir).where("flagged"), ["o_orderkey"]))
    return rounded(causal.block_homogeneity(f, _X), "homogeneity")


@query("""WITH m AS (SELECT o_orderkey, (o_orderkey % 30) / 100.0::DOUBLE AS d, (o_custkey % 40) / 10.0::DOUBLE AS z, o_orderkey % 4 AS n, (o_custkey % 50) / 10.0::DOUBLE AS i, o_orderkey % 5 = 0 AS s, (o_custkey % 70) / 100.0::DOUBLE AS h FROM orders),
v AS (SELECT o_orderkey, least(1, greatest(0, d / 0.15 * 0.7 + greatest(0, 1 - z / 2) * 0.3)) AS a, CASE WHEN i >= 2.5 THEN 0.55 ELSE 0 END::DOUBLE + CASE WHEN s THEN 0.45 ELSE 0 END::DOUBLE AS b, least(1, least(n / 2, 1) * 0.6 + CASE WHEN s THEN 0 ELSE 0.2 END::DOUBLE + CASE WHEN d < 0.15 THEN 0.2 ELSE 0 END::DOUBLE) AS c, least(1, h / 0.6) AS e FROM m)
SELECT o_orderkey, round(greatest(a, b, c, e), 6) AS confidence FROM v""")
def f17_fingerprint(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    m = o.select("o_orderkey", (k % 30 / 100.0).alias("label_delta"), (c % 40 / 10.0).alias("mean_feature_z"), (k % 4).alias("n_shifted"), (c % 50 / 10.0).alias("inertia_ratio"), (k % 5 == 0).alias("has_spike"), (c % 70 / 100.0).alias("homogeneity"))
    return rounded(causal.fingerprint(m), "confidence").select("o_orderkey", "confidence")


@query(f"WITH {_OSQL} SELECT round((abs(avg(a) FILTER (WHERE flagged) - avg(a) FILTER (WHERE NOT flagged)) + abs(avg(b) FILTER (WHERE flagged) - avg(b) FILTER (WHERE NOT flagged)) + abs(avg(c) FILTER (WHERE flagged) - avg(c) FILTER (WHERE NOT flagged))) / 3, 6) AS causal_effect FROM o")
def f18_unsupervised_effect(spark, sf_dir):
    return rounded(causal.unsupervised_effect(labelled(spark, sf_dir), _X), "causal_effect").select("causal_effect")


