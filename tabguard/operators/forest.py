"""Random forests of two classes from histograms, on equal rows held once.

Rows that agree in all bins are one row with its number n, in which a tree's bootstrap draws a Poisson number of mean n: as
many as n rows drawn one by one. All trees grow together; every level costs one Spark job that sums drawn rows by (tree,
node, feature, bin, class), of the features drawn for the node only. Draws go by buckets of row hashes, so a forest does not
depend on the partitioning. As in MLlib, splits are by Gini impurity over the square root of the features, at quantiles of
32, on the side of a value that many rows have which is nearer to the quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.operators import boosting
from tabguard.sources.tables import stored

BINS, DEPTH = 32, 5


def _buckets(rows: DataFrame, p: int) -> DataFrame:
    """Rows (codes, y, n) in blocks by the hash of codes and class, in order within a block."""
    count = max(1, -(-rows.count() // boosting.BLOCK))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("codes", "ascending"), ("y", "ascending")])
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(-1, p)
        whole = [np.ascontiguousarray(codes.T), t["y"].to_numpy().astype(np.uint8), t["n"].to_numpy()]
        return pa.table([t["bucket"].slice(0, 1), *[pa.array([v.tobytes()], pa.binary()) for v in whole]], names=["bucket", "codes", "y", "n"])

    placed = rows.select(F.pmod(F.xxhash64("codes", "y"), F.lit(count)).cast("int").alias("bucket"), "codes", "y", "n")
    return stored(placed.groupBy("bucket").applyInArrow(build, "bucket int, codes binary, y binary, n binary"), "forest")


def _level(batches: Iterator[pa.RecordBatch], trees: boosting.Trees, drawn: np.ndarray, level: int, p: int, seed: int) -> Iterator[pa.RecordBatch]:
    n_trees, nodes, q = drawn.shape
    total = np.zeros((n_trees, nodes * q * BINS * 2))
    for batch in batches:
        for i in range(len(batch)):
            codes, y, n = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in ((1, np.uint8), (2, np.uint8), (3, np.float64)))
            codes, rows = codes.reshape(p, -1).T, np.arange(len(y))
            for t in range(n_trees):
                times = np.random.default_rng([seed, t, batch.column(0)[i].as_py()]).poisson(n)
                node = trees.node(codes, t, level) - (nodes - 1)
                for k in range(q):
                    cell = ((node * q + k) * BINS + codes[rows, drawn[t, node, k]]) * 2 + y
                    total[t] += np.bincount(cell, times, total.shape[1])
    tree, cell = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[tree, cell])], names=["tree", "cell", "n"])


def _gini(n: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity, of (..., class) counts."""
    both = n.sum(-1)
    return both - np.divide((n * n).sum(-1), both, out=np.zeros_like(both), where=both > 0)


def _split(sums: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Which drawn feature and bin split a node best ((features, bins, classes) counts), and the classes of both sides."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:]
    right = whole - left
    gain = np.round(_gini(whole) - _gini(left) - _gini(right), 6)
    gain[(left.sum(-1) < 1) | (right.sum(-1) < 1)] = 0
    k, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(k), int(b), left[k, b], right[k, b]) if gain[k, b] > 0 else None


def cut_points(train: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Where splits may be: at each quantile's value, before or after the rows that have it."""
    at = [i / BINS for i in range(1, BINS)]
    q = train.agg(F.count("*").alias("n"), *[F.approx_percentile(c, at, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    if not q["n"]:
        return [np.zeros(1) for _ in features]
    below = train.agg(*[F.struct(*[F.count_if(F.col(c) < v).alias(f"_{k}") for k, v in enumerate(q[f"_{i}"])]).alias(f"_{i}") for i, c in enumerate(features)]).first()
    upto = train.agg(*[F.struct(*[F.count_if(F.col(c) <= v).alias(f"_{k}") for k, v in enumerate(q[f"_{i}"])]).alias(f"_{i}") for i, c in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        want, lo, hi = (np.array(v, float) for v in ([a * q["n"] for a in at], below[f"_{i}"], upto[f"_{i}"]))
        v = np.array(q[f"_{i}"], float)
        out.append(np.unique(np.where(np.abs(lo - want) < np.abs(hi - want), np.nextafter(v, -np.inf), v)))
    return out


def fit(train: DataFrame, features: list[str], n_trees: int, depth: int = DEPTH, seed: int = 42) -> boosting.Trees:
    """Trees whose leaves add up to the probability of class 1; ``train`` has the features and _y, 0 or 1."""
    p, cuts = len(features), cut_points(train, features)
    trees = boosting.Trees(cuts, depth)
    given = train.select(*features, F.lit(0).alias("fold"), F.col("_y").alias("y"), F.lit(False).alias("flagged"))
    rows = _buckets(stored(boosting.equal(given, features, cuts), "forest"), p)
    rng, q = np.random.default_rng(seed), math.ceil(math.sqrt(p))
    trees.features = [np.zeros(2**depth - 1, np.int64) for _ in range(n_trees)]
    trees.bins = [np.full(2**depth - 1, 255, np.int64) for _ in range(n_trees)]  # without a split everything goes left
    classes = np.zeros((n_trees, 2 ** (depth + 1) - 1, 2))
    open_ = np.zeros((n_trees, 2**depth - 1), bool)
    open_[:, 0] = True
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        drawn = rng.permuted(np.broadcast_to(np.arange(p), (n_trees, nodes, p)), axis=2)[:, :, :q]
        sums = rows.mapInArrow(lambda b, level=level, drawn=drawn: _level(b, trees, drawn, level, p, seed), "tree int, cell int, n double")
        found = sums.groupBy("tree", "cell").agg(F.sum("n").alias("n")).toArrow()  # trees x nodes x drawn features x bins x classes numbers
        n = np.zeros((n_trees, nodes * q * BINS * 2))
        n[found["tree"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
        n = n.reshape(n_trees, nodes, q, BINS, 2)
        for t in range(n_trees):
            for i in range(nodes):
                here, own = first + i, n[t, i, 0].sum(0)
                if not level:
                    classes[t, 0] = own
                split = _split(n[t, i]) if open_[t, here] else None
                if split is None:
                    classes[t, 2 * here + 1] = classes[t, here]
                    continue
                k, trees.bins[t][here], classes[t, 2 * here + 1], classes[t, 2 * here + 2] = split
                trees.features[t][here] = drawn[t, i, k]
                if level < depth - 1:
                    open_[t, 2 * here + 1 : 2 * here + 3] = True
    last = classes[:, 2**depth - 1 :]
    both = last.sum(-1)
    trees.leaves = list(np.divide(last[:, :, 1], both, out=np.full(both.shape, 0.5), where=both > 0) / n_trees)
    return trees
