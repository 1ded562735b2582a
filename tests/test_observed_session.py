"""Forests fit and score in a session that has observed a query before, as the cleaning report does."""

import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabguard.operators import causal, ensemble
from tabguard.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def observed(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 5
    return spark


def flipped(spark, n=300):
    """Rows whose label is the sign of f0, turned in every fifth, flagged row."""
    x = np.random.default_rng(4).standard_normal((n, 2))
    rows = [(i, *map(float, v), int((v[0] > 0) != (i % 5 == 0)), i % 5 == 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, label int, flagged boolean")


def test_forest_effect(observed):
    got = causal.tree_effect(flipped(observed), ["f0", "f1"], "label", "flagged", ["id"], "rf", 5).first()
    assert got["accuracy_without"] > 0.95 and got["accuracy_with"] < 0.85
    assert abs(got["effect"] - (got["accuracy_without"] - got["accuracy_with"])) < 1e-12


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_proof(observed):
    got = QUERIES["f10_proof"](observed, DATA).first()
    assert got["proof_valid"] and 0 < got["ci_low"] < got["ci_high"] and got["causal_effect"] > 0.05 and got["suspicion_score"] > 0


def test_forest_against_noise(observed):
    x = np.random.default_rng(8).standard_normal((400, 2)) * 0.1
    x[380:] += 3
    rows = [(i, *map(float, v), "reference" if i < 300 else "incoming") for i, v in enumerate(x)]
    df = observed.createDataFrame(rows, "id long, f0 double, f1 double, split string")
    got = ensemble.positive_unlabelled(df, ["f0", "f1"], ["id"], F.col("split") == "reference", "rf", 10)
    n = got.agg(F.count_if(F.col("rf_flag") & (F.col("id") >= 380)).alias("far"), F.count_if(F.col("rf_flag") & (F.col("id") < 300)).alias("own")).first()
    assert n["far"] == 20 and n["own"] <= 15
