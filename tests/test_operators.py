"""Properties and recomputations of operators that SQL does not check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.functions.numeric import binomial_tail, t_two_sided, unpivot
from tabguard.operators import causal, ensemble, inject, linalg, oneclass, prep, ranks, shift, spectral


def normals(spark, n=1500, p=4, seed=1, spike=0):
    x = np.random.default_rng(seed).standard_normal((n, p))
    if spike:
        x[-spike:, 0] = 9.99
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(p)))


F4 = ["f0", "f1", "f2", "f3"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(parts)
    rows = ranks.with_rank(df, ["k"], partitions=8).collect()
    assert len(rows) == 1000 and all(r["k"] == r["row_rank"] for r in rows)


def test_ranks_by_a_constant_column_and_a_text(spark):
    df = spark.range(500).select(F.lit(1).alias("one"), F.lpad(((F.col("id") * 7919) % 500).cast("string"), 3, "0").alias("k"))
    rows = ranks.with_rank(df, ["one", "k"], partitions=8).collect()
    assert sorted(r["row_rank"] for r in rows) == list(range(500)) and all(int(r["k"]) == r["row_rank"] for r in rows)


def test_ranks_of_an_empty_table_and_nulls(spark):
    assert ranks.with_rank(spark.createDataFrame([], "k long"), ["k"]).count() == 0
    rows = ranks.with_rank(spark.createDataFrame([(None,), (2,), (1,)], "k long"), ["k"]).collect()
    assert {r["k"]: r["row_rank"] for r in rows} == {None: 0, 1: 1, 2: 2}


def test_tails():
    assert binomial_tail(0, 10, 0.3) == 1.0
    assert abs(binomial_tail(3, 5, 0.5) - 0.5) < 1e-12
    assert abs(binomial_tail(8, 10, 0.5) - 56 / 1024) < 1e-12
    assert abs(t_two_sided(2.228138851964939, 10) - 0.05) < 1e-9


def test_spike_is_found_and_a_clean_table_is_quiet(spark):
    for planted in (0, 40):
        rows = prep.split_by_order(normals(spark, spike=planted), ["id"])
        hits = shift.exact_spike(unpivot(rows, F4, ["split"])).collect()
        assert [round(h["value"], 2) for h in hits] == ([9.99] if planted else [])


def test_covariance_and_robust_covariance(spark):
    df = normals(spark).select(*F4)
    cov, mean, n = linalg.covariance(df)
    x = np.array([list(r) for r in df.collect()])
    assert n == len(x) and np.allclose(cov, np.cov(x.T)) and np.allclose(mean, x.mean(0))
    robust, _ = linalg.robust_covariance(df, F4)
    assert np.all(np.abs(np.diag(robust) - 1) < 0.35)


def test_spectrum_is_the_singular_values(spark):
    df = normals(spark).select(F.array(*F4).alias("activation"))
    x = np.array([r["activation"] for r in df.collect()])
    s = np.linalg.svd(x, compute_uv=False)
    assert abs(spectral.spectrum(df).first()["spectral_gap"] - s[0] / s[1]) < 1e-9


def test_outliers_are_flagged_by_every_detector(spark):
    far = spark.createDataFrame([(10_000 + i, 12.0, -12.0, 12.0, -12.0) for i in range(5)], "id long, f0 double, f1 double, f2 double, f3 double")
    df = normals(spark, 600).withColumn("split", F.lit("reference")).unionByName(far.withColumn("split", F.lit("incoming")))
    own = F.col("split") == "reference"
    df = ensemble.isolation_forest(df, F4, ["id"], own, 40)
    df = ensemble.elliptic(ensemble.one_class(df, F4, own), F4, own)
    flags = ["isolation_flag", "oneclass_flag", "elliptic_flag"]
    got = df.where("split = 'incoming'").select(*flags).collect()
    assert len(got) == 5 and all(all(r) for r in got)
    assert df.where(own).agg(*[F.avg(F.col(c).cast("double")) for c in flags]).first()[0] < 0.08


def test_neighbours_are_exact(spark):
    df = normals(spark, 200)
    x = np.array([[r[c] for c in F4] for r in df.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r["key"], r["nth"]): r["distance"] for r in ensemble.nearest(df, df, F4, "id", 3, 64).collect()}
    want = np.sort(d, axis=1)[:, :3]
    assert all(abs(got[i, k + 1] - want[i, k]) < 1e-9 for i in range(200) for k in range(3))


def test_newton_equals_a_separate_fit_and_replicates_are_stable(spark):
    df = normals(spark, 400).withColumn("label", (F.col("f0") + F.col("f1") > 0).cast("int")).withColumn("flagged", F.col("id") % 10 == 0)
    models = causal.plan(0, 0, 2)
    beta, _ = causal.fit(df, F4, "label", "flagged", ["id"], models, 12)
    rows = causal.with_fold(df, ["id"]).collect()
    x = np.array([[*[r[c] for c in F4], 1.0] for r in rows if r["_fold"] != 0])
    y = np.array([r["label"] for r in rows if r["_fold"] != 0])
    b = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        pen = np.diag([1.0] * 4 + [1e-9])
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ b)
    assert np.allclose(beta[0], b, atol=1e-5)
    a = causal.replicates(df, F4, "label", "flagged", ["id"], 3, 2).orderBy("kind", "replicate").collect()
    c = causal.replicates(df.repartition(7), F4, "label", "flagged", ["id"], 3, 2).orderBy("kind", "replicate").collect()
    assert all(abs(p["effect"] - q["effect"]) < 1e-9 for p, q in zip(a, c, strict=True))


def test_injection_counts_and_stability(spark):
    df = normals(spark, 500).withColumn("label", (F.col("id") % 2).cast("int"))
    for f in (lambda d: inject.label_flip(d, ["id"], 30), lambda d: inject.slow_drift(d, ["id"], F4, 40), lambda d: inject.clean_label(d, ["id"], F4, 20), lambda d: inject.gradient_poisoning(d, ["id"], F4, {"f0": 0.5}, 15)):
        a = {r["id"] for r in f(df).where("poison_status = 'confirmed'").collect()}
        b = {r["id"] for r in f(df.repartition(5)).where("poison_status = 'confirmed'").collect()}
        assert a == b and len(a) in (30, 40, 20, 15)


def test_cleaning_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, label int")
    assert prep.minmax_scale(df, ["a", "b"]).count() == 0
    assert {r["n"] for r in prep.cleaning_report(df, ["a", "b"], "label").collect()} <= {0, None}
    assert prep.impute_median(df, ["a"]).count() == 0


def test_scans_read_only_what_they_need(spark, tmp_path):
    normals(spark, 50).write.parquet(str(tmp_path / "t"))
    plan = prep.profile(spark.read.parquet(str(tmp_path / "t")), ["f1"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<f1:double>" in plan


def test_streams_do_not_depend_on_micro_batches(spark, tmp_path):
    from tabguard.operators import drift
    from tabguard.streaming import stream

    r = np.random.default_rng(8)

    def files(df, name):
        """A file, and so a micro-batch, for each of 6 parts in no order."""
        df.repartition(6).write.parquet(str(tmp_path / name))
        return stream.read(spark, str(tmp_path / name), 1)

    shares = spark.createDataFrame([(k % 4, float(r.random()), float(r.random())) for k in range(200)], "batch int, a double, b double")
    whole = {x["batch"]: (x["step_drift"], x["cumulative_drift"]) for x in drift.drift(drift.snapshots(shares, ["a", "b"])).collect()}
    got = stream.drift_per_batch(files(shares, "shares"), ["a", "b"]).collect()
    assert len(got) == 3
    for x in got:
        assert np.allclose((x["step_drift"], x["cumulative_drift"]), whole[x["batch"]], atol=1e-9)


def test_outlier_factors_read_the_whole_vector(spark, tmp_path):
    from tabguard.plans.ensemble_queries import e04_local_outlier_factor

    x = np.random.default_rng(9).standard_normal((60, 64))
    x[7, 40] = 50.0  # an outlier in one late coordinate
    spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["key"]: r["lof"] for r in e04_local_outlier_factor(spark, str(tmp_path)).collect()}
    ref = [i for i in range(60) if i % 10 < 7]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = {i: sorted((j for j in ref if j != i), key=lambda j: d[i, j])[:10] for i in range(60)}
    kd = {i: d[i, near[i][-1]] for i in ref}
    reach = {i: np.mean([max(d[i, j], kd[j]) for j in near[i]]) + 1e-10 for i in range(60)}
    want = {i: np.mean([1 / reach[j] for j in near[i]]) * reach[i] for i in range(60)}
    assert len(got) == 60 and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert max(got, key=got.get) == 7


def test_too_few_rows_give_a_skip_reason(spark):
    rows = [shift.null_result(spark.range(n), least=30).first() for n in (0, 29, 30)]
    assert [r["skip_reason"] for r in rows] == ["insufficient_data", "insufficient_data", None]
    assert [r["n"] for r in rows] == [0, 29, 30] and all(r["verdict"] == "CLEAN" for r in rows)


def test_attribution_fits_the_first_batch_with_both_classes(spark):
    from tabguard.operators import drift

    r = np.random.default_rng(4)
    x = r.normal(size=(600, 2))
    rows = [(i, i // 200, float(x[i, 0]), float(x[i, 1]), 0 if i < 200 else int(x[i, 0] > 0 if i < 400 else x[i, 1] > 0)) for i in range(600)]
    got = drift.fitted_coefficients(spark.createDataFrame(rows, "id long, batch int, a double, b double, label int"), ["a", "b"], "label", ["id"])
    assert got["a"] > 2 and abs(got["b"]) < 0.5  # the second batch, not the third
    none = drift.fitted_coefficients(spark.createDataFrame(rows[:150], "id long, batch int, a double, b double, label int"), ["a", "b"], "label", ["id"])
    assert none == {"a": 0.0, "b": 0.0}


def ranks_of(v):
    return np.argsort(np.argsort(v))


def test_one_class_machine_against_a_kernel_solution(spark):
    n, nu = 400, 0.1
    df = normals(spark, n, seed=4)
    x = np.array([[r[c] for c in F4] for r in df.orderBy("id").collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (4 * x.var()))
    a, cap = np.full(n, 1 / n), 1 / (nu * n)
    for k in range(20_000):  # Frank-Wolfe steps on the dual with the exact kernel
        g = kernel @ a
        best = np.zeros(n)
        best[np.argsort(g)[: round(nu * n)]] = cap
        d = best - a
        if -(d @ g) < 1e-6 * (a @ g):
            break
        a = a + min(1.0, -(d @ g) / (d @ kernel @ d)) * d
    got = ensemble.one_class(df, F4, F.lit(True), nu, 512).orderBy("id").collect()
    assert np.corrcoef(ranks_of(-kernel @ a), ranks_of([r["oneclass_score"] for r in got]))[0, 1] > 0.9
    assert abs(sum(r["oneclass_flag"] for r in got) / n - nu) < 0.02
    again = ensemble.one_class(df.repartition(7), F4, F.lit(True), nu, 512).orderBy("id").collect()
    assert [r["oneclass_flag"] for r in got] == [r["oneclass_flag"] for r in again]


def test_nearest_point_of_a_hull():
    p = np.random.default_rng(2).standard_normal((60, 5)) + 1.5
    x = oneclass.nearest_point(lambda w: p[np.argmin(p @ w)], p.mean(0), 1e-9)
    assert (p @ x).min() >= (x @ x) * (1 - 1e-6)  # the plane through x parts the hull from the origin


def test_one_class_machine_without_reference_rows(spark):
    df = normals(spark, 5)
    assert [r["oneclass_score"] for r in ensemble.one_class(df, F4, F.lit(False)).collect()] == [0.0] * 5
    assert ensemble.one_class(df.where("id < 0"), F4, F.lit(True)).count() == 0


def silhouette_of(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        b = min(d[i, c == k].mean() for k in set(c) if k != c[i])
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        out.append(0.0 if own.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_is_euclidean_and_close_when_drawn(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((300, 3)), rng.standard_normal((60, 3)) + 3, np.zeros((40, 3)), [[9.0, 9.0, 9.0]]])
    c = np.array([0] * 300 + [1] * 60 + [0] * 40 + [2])
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(c, x, strict=True)], "cluster int, plane array<double>")
    want = silhouette_of(x, c)
    assert abs(spectral.silhouette(df).first()[0] - want) < 1e-9
    assert abs(spectral.silhouette(df.repartition(6), most=100).first()[0] - want) < 0.05
    assert spectral.silhouette(df.where("cluster = 1")).first()[0] == 0.0
    assert spectral.silhouette(df.where("cluster = 5")).first()[0] == 0.0


def test_profile_of_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((200, 6)), rng.standard_normal((12, 6)) * 0.05 + 8])
    r = spectral.cluster_profile(spark.createDataFrame([([float(v) for v in row],) for row in x], "activation array<double>")).first()
    s, e = np.linalg.svd(x, compute_uv=False), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert r["minority_count"] == 12 and abs(r["minority_ratio"] - 12 / 212) < 1e-12 and r["tightness"] < 0.5
    assert np.allclose(r["explained_variance"], e[:5] / e.sum()) and abs(r["spectral_gap"] - s[0] / s[1]) < 1e-9
    score = min(r["spectral_gap"] / 10, 0.5) * 0.4 + (0.15 - 12 / 212) / 0.15 * 0.4 + (1 - r["tightness"]) * 0.2
    assert abs(r["suspicion_score"] - score) < 1e-12 and r["backdoor_detected"] == (r["spectral_gap"] > 3)


def test_one_class_machine_keeps_rows_not_their_random_features(spark, monkeypatch):
    kept, store = [], oneclass.stored
    monkeypatch.setattr(oneclass, "stored", lambda df, name: kept.append(df.dtypes) or store(df, name))
    got = ensemble.one_class(normals(spark, 500, spike=5), F4, F.col("id") < 400).where("id >= 495").collect()
    assert all(r["oneclass_flag"] for r in got)
    assert [[t for _, t in k] for k in kept] == [["double"] * 4]
