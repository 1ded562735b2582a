"""Exact neighbours over pivots, density clusters, exact quantiles and boosting against plain numpy and MLlib."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.operators import boosting, causal, ensemble, graph, neighbours, quantiles


def clustered(spark, n=900, p=6, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 30, (25, p))
    x = centres[r.integers(25, size=n)] + r.normal(0, 1, (n, p))
    x[: n // 10] = x[0]  # a third of what a cell holds: repeated rows
    names = [f"f{i}" for i in range(p)]
    return spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], f"id long, {', '.join(f'{c} double' for c in names)}").repartition(4), x, names


def test_nearest_over_many_pivots(spark):
    df, x, names = clustered(spark)
    got = {(r["key"], r["nth"]): (r["other"], r["distance"]) for r in neighbours.nearest(df, df, names, "id", 4, cell=30).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]  # ties by id
    assert len(got) == 4 * len(x)
    assert all(got[i, k + 1][0] == order[i, k] and abs(got[i, k + 1][1] - d[i, order[i, k]]) < 1e-9 for i in range(len(x)) for k in range(4))


def test_few_pairs_meet_on_clustered_rows(spark):
    df, x, names = clustered(spark)
    cells = neighbours.Cells(df, names, "id", 30)
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 4]
    reach = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(d)], "key long, reach double")
    visits = cells.visits(cells.rows.join(reach, "key"), own=True).groupBy("to").count().collect()
    assert sum(r["count"] * cells.n[r["to"]] for r in visits) < 0.2 * len(x) ** 2


def test_too_few_rows_and_unstructured_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 5))
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, e double")
    few = df.where("id < 3")
    assert neighbours.nearest(few, few, list("abcde"), "id", 5, cell=1).count() == 6
    assert neighbours.nearest(df, df.where("false"), list("abcde"), "id", 2).count() == 0
    got = neighbours.nearest(df, df.where("id % 2 = 0"), list("abcde"), "id", 3, cell=10).groupBy("key").agg(F.max("distance").alias("d")).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all(abs(g["d"] - np.sort(d[g["key"], ::2])[2]) < 1e-9 for g in got) and len(got) == 150


def test_density_clusters(spark):
    df, x, names = clustered(spark, 500, 3, 4)
    eps, least = 1.1, 5
    got = {r["key"]: r for r in neighbours.density_clusters(df, names, "id", eps, least, cell=25).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.array([label[near[i] & core].min(initial=label[i]) if core[i] else len(x) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        mine = label[near[i] & core].min(initial=len(x))
        want = label[i] if core[i] else mine
        assert (got[i]["n"], got[i]["core"], got[i]["noise"]) == (near[i].sum(), core[i], want == len(x))
        assert got[i]["cluster"] == (None if want == len(x) else want)
    assert len({r["cluster"] for r in got.values()}) > 10


def test_components_of_paths_and_stars(spark):
    r = np.random.default_rng(1)
    names = r.permutation(300)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 260)] + [(names[260], names[260])]
    got = {x["key"]: x["component"] for x in graph.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    want = {int(k): int(names[lo:hi].min()) for lo, hi in ((0, 200), (200, 260)) for k in names[lo:hi]}
    assert got == want


@pytest.mark.parametrize("rest", [1, 7, 1 << 15])
def test_quantiles_are_exact(spark, rest):
    r = np.random.default_rng(3)
    at = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    sets = {"normal": r.normal(size=1001), "one": np.array([3.5]), "same": np.full(400, -2.0), "few": r.integers(0, 4, 500).astype(float), "wild": np.concatenate([r.normal(size=300), [1e300, -1e300, 1e-300, 0.0, -0.0]]), "near": 1 + r.integers(0, 50, 300) * 2.0**-52}
    rows = [(k, "s", float(v)) for k, x in sets.items() for v in x] + [("one", "s", None), ("none", "s", None), ("one", "s", float("nan"))]
    df = spark.createDataFrame(rows, "feature string, segment string, value double").repartition(3)
    got = {x["feature"]: x for x in quantiles.percentiles(df, ["segment", "feature"], "value", at, rest, 8).collect()}
    assert set(got) == set(sets)
    for k, x in sets.items():
        assert got[k]["n"] == len(x)
        pos = np.array(at) * (len(x) - 1)
        s = np.sort(x)
        want = [s[int(p)] if p == int(p) else s[int(p)] + (s[int(p) + 1] - s[int(p)]) * (p - int(p)) for p in pos]
        assert got[k]["q"] == want


def test_boosting_is_as_good_as_mllib(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.normal(size=1500) > 0.4).astype(int)
    df = spark.createDataFrame([(int(i), *map(float, x[i]), int(y[i]), bool(i % 10 == 0)) for i in range(1500)], "id long, a double, b double, c double, d double, label int, flagged boolean")
    d = causal.stratified_fold(df, ["id"], "label", 2)
    got = {(q["arm"], q["fold"]): q["correct"] / q["seen"] for q in boosting.accuracies(d, list("abcd"), "label", "flagged", [0, 1], 20, 0.2).collect()}
    v = d.withColumn("v", array_to_vector(F.array(*"abcd")))
    own = [GBTClassifier(maxIter=20, maxDepth=3, featuresCol="v", labelCol="label", seed=1).fit(v.where(F.col("_fold") != k)).transform(v.where(F.col("_fold") == k)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] for k in (0, 1)]
    assert len(got) == 4 and (got[0, 0] + got[0, 1]) / 2 > np.mean(own) - 0.01
    again = {(q["arm"], q["fold"]): q["correct"] / q["seen"] for q in boosting.accuracies(d.repartition(5), list("abcd"), "label", "flagged", [0, 1], 20, 0.2).collect()}
    assert again == got


def test_boosting_of_three_classes_and_single_class(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 2))
    df = spark.createDataFrame([(int(i), float(x[i, 0]), float(x[i, 1]) if i % 50 else None, int((x[i, 0] > -0.5) + (x[i, 0] > 0.5)), bool(i % 7 == 0)) for i in range(600)], "id long, a double, b double, label int, flagged boolean")
    out = causal.tree_effect(df, ["a", "b"], "label", "flagged", ["id"], "gbt", 8).first()
    assert out["accuracy_with"] > 0.97 and out["accuracy_without"] > 0.97
    assert causal.tree_effect(df.withColumn("label", F.lit(1)), ["a", "b"], "label", "flagged", ["id"], "gbt", 2).first()["accuracy_with"] == 1.0


def test_a_fit_by_hand(spark):
    """One feature, one tree of depth 1: the split and leaves as on paper."""
    df = spark.createDataFrame([(float(v), float(v > 3)) for v in range(8)], "v double, y double").select("v", F.lit(0).alias("fold"), "y", F.lit(False).alias("flagged"))
    cuts = [np.arange(7) + 0.5]
    rows = boosting.coded(df, ["v"], ["fold", "y", "flagged"], boosting.Trees(cuts))
    t = boosting.fit(rows, cuts, [(0, -1, 1)], 1, 0.5, 1)[0]
    assert t.base == 0 and t.bins[0].tolist() == [3] and np.allclose(t.leaves[0], [-0.5 * 2 / (1 + 1), 0.5 * 2 / (1 + 1)])


def test_robust_covariance_withstands_a_third_of_poison(spark):
    from tabguard.operators import linalg

    r = np.random.default_rng(6)
    x = r.normal(size=(1000, 4))
    x[:300] = 7 + 0.2 * r.normal(size=(300, 4))
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double")
    names = list("abcd")

    def flagged(starts):
        cov, mean = linalg.robust_covariance(df, names, 0.65, starts=starts)
        far = linalg.squared_distance(df, names, mean, linalg.inverse(cov)).where("d2 > 14.86").select("id").collect()  # 99.5 % of four degrees
        return cov, {q["id"] for q in far}

    cov, found = flagged(100)
    assert set(range(300)) <= found and len(found) < 330
    assert np.allclose(cov, np.cov(x[300:], rowvar=False), atol=0.25)
    assert not set(range(300)) <= flagged(0)[1]


def test_boosting_passes_go_over_few_blocks_and_equal_rows(spark):
    r = np.random.default_rng(9)
    x = r.integers(0, 6, (5000, 3)).astype(float)
    x[::50, 1] = np.nan
    given = spark.createDataFrame([(*map(float, v), int(i % 3), float(v[0] + v[2] > 5), bool(i % 11 == 0)) for i, v in enumerate(x)], "a double, b double, c double, fold int, y double, flagged boolean").repartition(3)
    cuts, models = boosting.cut_points(given, list("abc")), [(arm, f, 1) for arm in (0, 1) for f in range(3)]
    plain = boosting.coded(given, list("abc"), ["fold", "y", "flagged"], boosting.Trees(cuts))
    equal = boosting.equal(given, list("abc"), cuts)
    assert equal.agg(F.sum("n")).first()[0] == 5000 and equal.count() <= 6 * 7 * 6 * 3 * 2
    assert boosting.blocked(plain, 3).count() <= 3
    one, two = (boosting.fit(rows, cuts, models, 12, 0.3) for rows in (plain, equal))
    for s, t in zip(one, two, strict=True):
        assert s.base == t.base and len(t.leaves) == 12
        assert all((a == b).all() for a, b in zip(s.features + s.bins, t.features + t.bins, strict=True)) and np.allclose(s.leaves, t.leaves)
        codes = t.codes(x)  # nodes by walking down one row at a time
        for k in (0, 7):
            at = np.zeros(len(x), int)
            for _ in range(t.depth):
                at = np.array([2 * n + 1 + (codes[i, t.features[k][n]] > t.bins[k][n]) for i, n in enumerate(at)])
            assert (t.node(codes, k, t.depth) == at).all()


def unstructured(spark, n=300, p=8):
    """Rows without clusters, some of them copies: a row meets all cells."""
    x = np.random.default_rng(11).normal(size=(n, p))
    x[200:240] = x[:40]
    names = [f"f{i}" for i in range(p)]
    return spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], f"id long, {', '.join(f'{c} double' for c in names)}"), x, names


def written(monkeypatch):
    """Rows of every table that neighbours are kept in."""
    kept, store = [], neighbours.stored

    def counted(df, name):
        out = store(df, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "stored", counted)
    return kept


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


def test_density_edges_grow_with_rows_not_with_pairs_of_cells(spark, monkeypatch):
    df, x, names = unstructured(spark)
    kept = written(monkeypatch)
    got = neighbours.density_clusters(df, names, "id", 9.0, 5, cell=10).collect()
    assert {(r["n"] > 290, r["core"], r["noise"], r["cluster"]) for r in got} == {(True, True, False, 0)} and len(got) == 300
    assert max(kept) <= 16 * 300  # as many forests as tasks, of 4 x 4 partitions; a visit of every cell was a row


def test_density_noise_joins_no_clusters(spark, monkeypatch):
    df, x, names = unstructured(spark)
    d = distances(x)
    eps, least = 2.2, 6
    want = neighbours.density_clusters(df, names, "id", eps, least, cell=10).select("key", "noise").collect()
    monkeypatch.setattr(neighbours, "components", None)
    kept = written(monkeypatch)
    got = {r["key"]: r["noise"] for r in ensemble.density_noise(df, names, "id", eps, least).collect()}
    core = (d <= eps).sum(1) + 1 >= least
    assert got == {i: not core[i] and not (core & (d[i] <= eps)).any() for i in range(300)} == dict(map(tuple, want))
    assert 0 < sum(got.values()) < 300
    kept.clear()
    assert neighbours.density_noise(df, names, "id", eps, least, cell=10).count() == 300 and max(kept) <= 5 * 300


def test_outlier_factor_writes_what_grows_with_rows(spark, monkeypatch):
    df, x, names = unstructured(spark)
    kept = written(monkeypatch)
    monkeypatch.setattr(ensemble, "nearest", lambda *a: neighbours.nearest(*a, cell=10))
    got = {r["key"]: r["lof"] for r in ensemble.local_outlier_factor(df, df.where("id < 200"), names, "id", 4).collect()}
    d = distances(x)[:, :200]
    at = np.argsort(d, axis=1, kind="stable")[:, :4]  # ties by id
    far = np.take_along_axis(d, at, 1)
    dense = 1 / (np.maximum(far, far[at, 3].reshape(at.shape)).mean(1) + 1e-10)
    assert all(abs(got[i] - dense[at[i]].mean() / dense[i]) < 1e-6 for i in range(300))
    assert max(kept) <= 4 * 300


def test_estimated_eps_writes_what_grows_with_rows(spark, monkeypatch):
    df, x, names = unstructured(spark)
    kept = written(monkeypatch)
    monkeypatch.setattr(ensemble, "nearest", lambda *a: neighbours.nearest(*a, cell=10))
    got = ensemble.estimate_eps(df, names, "id").first()["eps"]
    assert abs(got - np.quantile(np.sort(distances(x), axis=1)[:, 3], 0.9)) < 1e-9
    assert max(kept) <= 4 * 300


def test_nearest_of_copies_in_many_blocks_writes_what_grows_with_rows(spark, monkeypatch):
    df, x, names = unstructured(spark)
    x[100:160] = x[0]
    df = spark.createDataFrame([(f"{i:03d}", *map(float, v)) for i, v in enumerate(x)], f"id string, {', '.join(f'{c} double' for c in names)}")
    kept = written(monkeypatch)
    got = {(r["key"], r["nth"]): (r["other"], r["distance"]) for r in neighbours.nearest(df, df, names, "id", 5, cell=10).collect()}
    d = distances(x)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]  # ties by key
    assert len(got) == 5 * 300 and max(kept) <= 5 * 300
    assert all(got[f"{i:03d}", k + 1][0] == f"{order[i, k]:03d}" and abs(got[f"{i:03d}", k + 1][1] - d[i, order[i, k]]) < 1e-9 for i in range(300) for k in range(5))
