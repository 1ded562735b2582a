"""Boosted trees of many models at once, from histograms.

Values become one-byte bin numbers once; rows that agree in all of them are held once with their number, and ``BLOCK`` rows
are one row of arrays, so that a pass costs Spark nothing a row. Then every level of every tree costs one Spark job,
whatever the number of models (folds, arms of an experiment, classes): a pass over the rows sums gradients and Hessians by
(model, node, feature, bin), the sums of all tasks are added in Spark, and the driver gets models x nodes x features x bins
numbers to choose the splits from. Rows keep the margin that they had after the last ``REFRESH`` rounds in the shared
folder, so that a pass goes through a few trees and not through all, and lineage stays short.

Newton steps on the logistic loss: a leaf is -G / (H + penalty), a split's gain the usual difference of G^2 / (H + penalty).
Null and NaN values are in the lowest bin. Results do not depend on the partitioning but for the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.sources.tables import stored

BINS, DEPTH, RATE, PENALTY, LEAST_HESSIAN = 64, 3, 0.1, 1.0, 1e-3
#: Rounds after which the rows' margins are written again.
REFRESH = 10
#: Rows of a block.
BLOCK = 1 << 15


@dataclass
class Trees:
    """Full binary trees of one depth: the split of inner node i leads to nodes 2 i + 1 and 2 i + 2."""

    cuts: list[np.ndarray]
    depth: int = DEPTH
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), side="left") for j, c in enumerate(self.cuts)]).astype(np.uint8)

    def node(self, codes: np.ndarray, t: int, level: int) -> np.ndarray:
        """The node of tree ``t`` at ``level`` that each row is in."""
        at = np.zeros(len(codes), np.int64)
        for k in range(level):
            first = 2**k - 1
            right = codes[:, self.features[t][first]] > self.bins[t][first]
            for i in range(first + 1, 2 * first + 1):
                right = np.where(at == i, codes[:, self.features[t][i]] > self.bins[t][i], right)
            at = 2 * at + 1 + right
        return at

    def margins(self, codes: np.ndarray, first: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        """Sum of the leaves of trees from ``first`` on, added to ``start``."""
        m = np.full(len(codes), self.base) if start is None else start.copy()
        for t in range(first, len(self.leaves)):
            m += self.leaves[t][self.node(codes, t, self.depth) - (2**self.depth - 1)]
        return m


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cut points a feature, at approximate quantiles: they only say where splits may be."""
    at = [i / bins for i in range(1, bins)]
    q = df.agg(*[F.approx_percentile(F.when(~F.isnan(c), F.col(c).cast("double")), at, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q[i] or [0.0], float)) for i in range(len(features))]


def _coded(batches: Iterator[pa.RecordBatch], trees: Trees, p: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(p)])
        flat = pa.py_buffer(trees.codes(x).tobytes())
        coded = pa.Array.from_buffers(pa.binary(p), len(x), [None, flat]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([coded, *batch.columns[p:]], names=["codes", *batch.schema.names[p:]])


def coded(df: DataFrame, features: list[str], keep: list[str], trees: Trees) -> DataFrame:
    """codes (a byte per feature) and the columns ``keep``."""
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)], *keep)
    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(lambda b: _coded(b, trees, len(features)), f"codes binary, {kept}")


#: Arrays of a block; margins (a column per model) follow.
_KINDS = {"codes": np.uint8, "fold": np.int32, "y": np.float64, "flagged": np.bool_, "n": np.float64}
_BLOCKS = ", ".join(f"{c} binary" for c in _KINDS)


def _blocked(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    def block(parts: list[dict]) -> pa.RecordBatch:
        whole = {c: np.concatenate([x[c] for x in parts]) for c in _KINDS}
        whole["codes"] = np.ascontiguousarray(whole["codes"].T)
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in whole.values()], names=list(_KINDS))

    held: list[dict] = []
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        part = {c: get(c).to_numpy(zero_copy_only=False).astype(k) for c, k in _KINDS.items() if c in batch.schema.names and c != "codes"}
        part["codes"] = np.frombuffer(b"".join(get("codes").to_pylist()), np.uint8).reshape(len(batch), p)
        part.setdefault("n", np.ones(len(batch)))
        held.append(part)
        if sum(len(x["y"]) for x in held) >= BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def blocked(rows: DataFrame, p: int) -> DataFrame:
    """Rows with codes, fold, y, flagged (and n) in blocks."""
    return rows.mapInArrow(lambda b: _blocked(b, p), _BLOCKS)


def _read(batches: Iterator[pa.RecordBatch], p: int, models: int) -> Iterator[tuple]:
    """Of each block: codes, fold, class, left out, how many rows each stands for, and the stored margins (a column per model)."""
    for batch in batches:
        for i in range(len(batch)):
            got = {c: np.frombuffer(batch.column(j)[i].as_buffer(), _KINDS.get(c, np.float64)) for j, c in enumerate(batch.schema.names)}
            margins = got["margins"].reshape(models, -1).T if "margins" in got else None
            yield got["codes"].reshape(p, -1).T, got["fold"], got["y"], got["flagged"], got["n"], margins


def equal(given: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """codes, fold, y, flagged and n: rows that agree in all bins are one row with their number."""
    return coded(given, features, ["fold", "y", "flagged"], Trees(cuts)).groupBy("codes", "fold", "y", "flagged").agg(F.count("*").cast("double").alias("n"))


def _trains(model: tuple, fold: np.ndarray, flagged: np.ndarray) -> np.ndarray:
    arm, f, _ = model
    return (fold != f) & ~(flagged if arm else np.zeros(len(flagged), bool))


def _sums(batches: Iterator[pa.RecordBatch], models: list[tuple], trees: list[Trees], done: int, level: int, p: int, bins: int) -> Iterator[pa.RecordBatch]:
    nodes = 2**level
    total = np.zeros((len(models), nodes * p * bins, 2))
    for codes, fold, y, flagged, n, margins in _read(batches, p, len(models)):
        for m, model in enumerate(models):
            mine = np.flatnonzero(_trains(model, fold, flagged))
            mine = slice(None) if len(mine) == len(codes) else mine
            c = codes.T[:, mine].T
            rounds = len(trees[m].leaves)
            margin = trees[m].margins(c, done, None if margins is None else margins[mine, m])
            prob = 1 / (1 + np.exp(-margin))
            g, h = n[mine] * (prob - (y[mine] == model[2])), n[mine] * prob * (1 - prob)
            node = trees[m].node(c, rounds, level) - (nodes - 1) if level else np.zeros(len(c), np.int64)
            for j in range(p):
                cell = (node * p + j) * bins + c[:, j]
                total[m, :, 0] += np.bincount(cell, g, nodes * p * bins)
                total[m, :, 1] += np.bincount(cell, h, nodes * p * bins)
    model, cell = np.nonzero(total[:, :, 1])
    yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[model, cell, 0]), pa.array(total[model, cell, 1])], names=["model", "cell", "g", "h"])


def _counts(batches: Iterator[pa.RecordBatch], models: list[tuple], p: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(models), 2))
    for _, fold, y, flagged, n, _ in _read(batches, p, len(models)):
        for m, model in enumerate(models):
            mine = _trains(model, fold, flagged)
            total[m] += n[mine].sum(), n[mine & (y == model[2])].sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["model", "n", "positive"])


def _with_margins(batches: Iterator[pa.RecordBatch], models: list[tuple], trees: list[Trees], done: int, p: int) -> Iterator[pa.RecordBatch]:
    for codes, *own, margins in _read(batches, p, len(models)):
        m = np.concatenate([t.margins(codes, done, None if margins is None else margins[:, i]) for i, t in enumerate(trees)])
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (np.ascontiguousarray(codes.T), *own, m)], names=[*_KINDS, "margins"])


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Feature and bin of the best split of one node ((features, bins) sums), and the sums of its two sides."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    gt, ht = gl[0, -1], hl[0, -1]
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - gt**2 / (ht + penalty)
    gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), np.round(gain, 9), -np.inf)
    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[j, b] > 0:  # no split: everything goes left
        return 0, 255, np.array([gt, 0.0]), np.array([ht, 0.0])
    return int(j), int(b), np.array([gl[j, b], gr[j, b]]), np.array([hl[j, b], hr[j, b]])


def fit(rows: DataFrame, cuts: list[np.ndarray], models: list[tuple], rounds: int, rate: float = RATE, depth: int = DEPTH, penalty: float = PENALTY) -> list[Trees]:
    """One ensemble for each (arm, fold, class) of ``models``.

    ``rows`` has codes, fold, y, flagged and, where equal rows are held once, their number n. A model learns
    "y is the class" from the rows of the other folds, arm 1 without flagged ones.
    """
    p, bins, n_models = len(cuts), max(len(c) for c in cuts) + 1, len(models)
    trees = [Trees(cuts, depth) for _ in models]
    rows = stored(blocked(rows, p), "boosting")
    for r in rows.mapInArrow(lambda b: _counts(b, models, p), "model int, n double, positive double").groupBy("model").agg(F.sum("n").alias("n"), F.sum("positive").alias("k")).collect():  # a row per model
        share = min(max(r["k"] / r["n"], 1e-6), 1 - 1e-6) if r["n"] else 0.5
        trees[r["model"]].base = float(np.log(share / (1 - share)))
    done = 0
    for t in range(rounds):
        for m in trees:
            m.features.append(np.zeros(2**depth - 1, np.int64))
            m.bins.append(np.full(2**depth - 1, 255, np.int64))
        for level in range(depth):
            nodes = 2**level
            sums = rows.mapInArrow(lambda b, done=done, level=level: _sums(b, models, trees, done, level, p, bins), "model int, cell int, g double, h double")
            found = sums.groupBy("model", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # models x nodes x features x bins numbers
            g, h = np.zeros((n_models, nodes * p * bins)), np.zeros((n_models, nodes * p * bins))
            at = found["model"].to_numpy(), found["cell"].to_numpy()
            g[at], h[at] = found["g"].to_numpy(), found["h"].to_numpy()
            leaves = []
            for i, m in enumerate(trees):
                for node in range(nodes):
                    j, b, gs, hs = _split(g[i].reshape(nodes, p, bins)[node], h[i].reshape(nodes, p, bins)[node], penalty)
                    m.features[t][nodes - 1 + node], m.bins[t][nodes - 1 + node] = j, b
                    leaves.append(-rate * gs / (hs + penalty))
            if level == depth - 1:
                for i, m in enumerate(trees):
                    m.leaves.append(np.concatenate(leaves[i * nodes : (i + 1) * nodes]))
        if (t + 1) % REFRESH == 0 and t + 1 < rounds:
            rows = stored(rows.mapInArrow(lambda b, done=done: _with_margins(b, models, trees, done, p), f"{_BLOCKS}, margins binary"), "boosting")
            done = t + 1
    return trees


def scored(df: DataFrame, features: list[str], trees: Trees, name: str) -> DataFrame:
    """``df`` with the ensemble's probability."""

    def probability(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(features)))
        return pd.Series(1 / (1 + np.exp(-trees.margins(trees.codes(x)))))

    return df.withColumn(name, F.pandas_udf(probability, "double")(F.array(*[F.col(c).cast("double") for c in features])))


def _hits(batches: Iterator[pa.RecordBatch], models: list[tuple], trees: list[Trees], p: int) -> Iterator[pa.RecordBatch]:
    arms = sorted({m[:2] for m in models})
    total = np.zeros((len(arms), 2))
    for codes, fold, y, flagged, n, _ in _read(batches, p, len(models)):
        for a, (arm, f) in enumerate(arms):
            mine = np.flatnonzero((fold == f) & ~(flagged if arm else np.zeros(len(flagged), bool)))
            own = [(m[2], t) for m, t in zip(models, trees, strict=True) if m[:2] == (arm, f)]
            margins = np.column_stack([t.margins(codes[mine]) for _, t in own])
            classes = np.array([c for c, _ in own])
            said = classes[margins.argmax(1)] if len(own) > 1 else np.where(margins[:, 0] > 0, classes[0], 1 - classes[0])
            total[a] += n[mine][said == y[mine]].sum(), n[mine].sum()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in arms], pa.int32()), pa.array([x[1] for x in arms], pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["arm", "fold", "correct", "seen"])


def accuracies(df: DataFrame, features: list[str], label: str, flagged: str, folds: list[int], rounds: int, rate: float = RATE) -> DataFrame:
    """arm, fold, correct, seen of both arms (1 leaves flagged rows out) on held-out folds (column _fold); rows without a label are left out.

    Two classes are one model, more are one model each, of which the surest decides. Classes are numbered by value.
    """
    labelled = df.where(F.col(label).isNotNull())
    values = [r[0] for r in labelled.select(label).distinct().orderBy(label).collect()]  # a row per class
    number = F.coalesce(*[F.when(F.col(label) == v, F.lit(float(i))) for i, v in enumerate(values)], F.lit(0.0)) if values else F.lit(0.0)
    classes = [1] if len(values) <= 2 else list(range(len(values)))
    models = [(arm, f, c) for arm in (0, 1) for f in folds for c in classes]
    given = labelled.select(*features, F.col("_fold").cast("int").alias("fold"), number.alias("y"), F.coalesce(F.col(flagged), F.lit(False)).alias("flagged"))
    cuts = cut_points(given, features)
    rows = stored(equal(given, features, cuts), "boosting")
    trees = fit(rows, cuts, models, rounds, rate)
    return blocked(rows, len(features)).mapInArrow(lambda b: _hits(b, models, trees, len(features)), "arm int, fold int, correct double, seen double").groupBy("arm", "fold").agg(F.sum("correct").alias("correct"), F.sum("seen").alias("seen"))
