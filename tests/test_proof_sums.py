"""The proof's models from blocks of rows, and from equal rows held once, against plain sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabguard.operators import boosting, causal


def test_newton_sums_and_hits_of_blocks(monkeypatch):
    monkeypatch.setattr(causal, "CELLS", 50, raising=False)  # several blocks a fold
    rng, n = np.random.default_rng(5), 90
    x, h, fold, flagged = rng.standard_normal((n, 2)), rng.integers(-(2**62), 2**62, n), rng.integers(0, 3, n).astype(np.int32), rng.random(n) < 0.3
    y = (x[:, 0] > 0).astype(float)
    models = [*causal.plan(2, 1), ("full", 0, 0, -1)]
    beta = rng.standard_normal((len(models), 3))
    batch = pa.RecordBatch.from_arrays([*map(pa.array, (x[:, 0], x[:, 1], y, flagged, h, fold))], names=["_x0", "_x1", "y", "flagged", "_hash", "_fold"])
    sums, hits = (next(f(iter([batch, batch.slice(0, 0)]), models, beta, 0.3)).to_pylist() for f in (causal._steps, causal._hits))
    x = np.column_stack([x, np.ones(n)])
    for m, (kind, r, arm, f) in enumerate(models):
        w = causal._weights([(kind, r, arm)], h, flagged, 0.3)[0]
        assert kind != "full" or (w == (~flagged if arm else 1)).all()
        p, t = 1 / (1 + np.exp(-x @ beta[m])), w * (fold != f)
        hessian = (x * (t * p * (1 - p))[:, None]).T @ x
        assert np.allclose(sums[m]["sums"], [*hessian[np.triu_indices(3)], *(x.T @ (t * (y - p)))])
        assert np.isclose(hits[m]["correct"], (w * (fold == f) * ((x @ beta[m] > 0) == (y > 0.5))).sum()) and np.isclose(hits[m]["seen"], (w * (fold == f)).sum())


def test_equal_rows_are_held_once(spark, monkeypatch):
    seen, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, *a: seen.append((rows, *a)) or fit(rows, *a))
    df = spark.range(1200).select("id", (F.col("id") % 4).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("double").alias("b"), (F.col("id") % 7 == 0).alias("flagged"), (F.col("id") % 3).cast("int").alias("_fold"))
    df = df.withColumn("label", ((F.col("a") > 1) != ((F.col("b") > 3) | F.col("flagged"))).cast("int"))
    got = {(r["arm"], r["fold"]): (r["correct"], r["seen"]) for r in boosting.accuracies(df, ["a", "b"], "label", "flagged", [0, 1, 2], 12).collect()}
    rows, cuts, models, rounds, rate = seen[0]
    assert rows.count() <= 4 * 5 * 3 * 2 and rows.agg(F.sum("n")).first()[0] == 1200
    given = df.select("a", "b", F.col("_fold").alias("fold"), F.col("label").cast("double").alias("y"), "flagged")
    plain = fit(boosting.coded(given, ["a", "b"], ["fold", "y", "flagged"], boosting.Trees(cuts)), cuts, models, rounds, rate)
    for one, other in zip(fit(rows, cuts, models, rounds, rate), plain, strict=True):
        assert abs(one.base - other.base) < 1e-12 and np.allclose(one.leaves, other.leaves)
        assert (np.array(one.features) == other.features).all() and (np.array(one.bins) == other.bins).all()
    n = {(a, f): df.where((F.col("_fold") == f) & (F.lit(not a) | ~F.col("flagged"))).count() for a in (0, 1) for f in range(3)}
    assert {k: v[1] for k, v in got.items()} == n and all(0 <= v[0] <= v[1] for v in got.values())
