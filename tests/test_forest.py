"""Random forests from histograms of equal rows against MLlib, and what they keep on disk."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabguard.operators import ensemble, forest


def loss(p, y):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()


def test_forest_is_as_good_as_mllib_and_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 5, 4000) / 4, r.random(4000), r.normal(size=4000), np.ones(4000)])
    y = ((x[:, 0] == 0.5) | (x[:, 1] + 0.2 * x[:, 2] > 0.8)).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(k)) for v, k in zip(x, y, strict=True)], "a double, b double, c double, d double, _y double")
    trees = forest.fit(df, list("abcd"), 30)
    again = forest.fit(df.repartition(5), list("abcd"), 30)
    assert all(np.allclose(s, t) for s, t in zip(trees.leaves, again.leaves, strict=True)) and (np.array(trees.bins) == again.bins).all()
    own = trees.margins(trees.codes(x))
    assert own.min() >= 0 and own.max() <= 1 + 1e-9
    v = df.withColumn("v", array_to_vector(F.array(*"abcd")))
    got = RandomForestClassifier(numTrees=30, maxDepth=5, seed=1, featuresCol="v", labelCol="_y").fit(v).transform(v).select("_y", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).toPandas()
    assert loss(own, y) < loss(got["p"].to_numpy(), got["_y"].to_numpy()) + 0.02
    one = forest.fit(df.withColumn("_y", F.lit(1.0)), list("abcd"), 3)
    assert np.allclose(one.margins(one.codes(x)), 1)


def test_forest_against_noise_persists_no_rows(spark, monkeypatch):
    x = np.random.default_rng(8).integers(0, 3, (3000, 2)) / 2
    x[2900:] = 1.4
    df = spark.createDataFrame([(i, *map(float, v), "reference" if i < 2900 else "incoming") for i, v in enumerate(x)], "id long, f0 double, f1 double, split string")
    kept, store = [], forest.stored
    monkeypatch.setattr(forest, "stored", lambda df, name: (out := store(df, name), kept.append(out.count()))[0])
    out = ensemble.positive_unlabelled(df, ["f0", "f1"], ["id"], F.col("split") == "reference", "rf", 20)
    assert out.where("rf_flag AND id >= 2900").count() == 100 and out.where("rf_flag AND id < 2900").count() <= 145
    assert kept[0] < 2 * 2900 * 0.6 and kept[1] == 1  # 2,900 rows in nine cells, noise in its own; one block
