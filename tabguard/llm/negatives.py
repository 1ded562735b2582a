"""Hard-negative mining by a secondary-sort shuffle.

Anchors are scored against all rows in cells: a cell has a block of anchors and a share of the rows, meets its anchors
first and then lets the rows stream past, one matrix product per batch. A pair's score, kind and row id are packed into the
sort key (anchor, score falling, positives first, id), so that ``repartitionAndSortWithinPartitions`` - here a repartition
by anchor sorted within partitions - brings an anchor's pairs to one task in the order that decides. An iterator passes
over them once: each of the first positives opens the window of scores that its negatives may have, every negative goes to
the windows it falls into, and a window closes when it is full. It keeps a handful of open windows and no pair.

Cells send only what can decide. Their first pass keeps an anchor's best positives, and the shuffle brings these to the
final ones; in the second pass the anchors come with their windows, and a cell keeps the first negatives of each. A row that
is not among the first of its cell is not among the first of all, so nothing is lost, and an anchor's pairs in the shuffle
grow with the number of cells and not with that of rows.

Defined results: rows whose id, label or vector is null, or which have a null or non-finite component, take no part; a
missing component counts as 0 where vectors differ in length; an id that several rows have counts once, with its least
label and vector; anchors without positives or without negatives in a window give no rows; an empty table gives an empty
result; further columns are ignored. A score beyond 2**53 is an error, since it would not be exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import freed, stored

# The windows in percent of the positive's score, positives of an anchor, negatives of a window.
LOW, HIGH, POSITIVES, NEGATIVES = 30, 90, 5, 10
#: Anchors of a cell, rows scored at once, and rows that a cell gets where the table is large.
ANCHORS, AT_ONCE, SHARE = 1024, 2048, 1 << 18
#: Scores up to here are exact as doubles.
EXACT = float(1 << 53)
_PAIR = "anchor_id long, score long, is_negative boolean, id long"


# ---- cells -----------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled with 0 to one length."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d and len(a) and len(b) and float(np.abs(a).sum(axis=1).max()) * float(np.abs(b).max()) >= EXACT:
        if (np.abs(a) @ np.abs(b).T).max() >= EXACT:
            raise ValueError("a score is beyond 2**53")
    return a @ b.T


class Best:
    """The first ``most`` (score falling, id rising) of every list, added to in batches."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.score = np.full((lists, most), -np.inf)
        self.id = np.full((lists, most), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray, which: np.ndarray | slice = slice(None)) -> None:
        """Scores of some lists (rows) and candidates (columns); -inf where a candidate is none for the list."""
        if score.shape[1] > self.most:  # only candidates as good as the most-th can enter
            bar = np.maximum(np.partition(score, score.shape[1] - self.most, axis=1)[:, -self.most], self.score[which][:, -1])
        else:
            bar = self.score[which][:, -1]
        at, col = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
        if not len(at):
            return
        own_s, own_i = self.score[which], self.id[which]
        rows = np.concatenate([np.repeat(np.arange(len(own_s)), self.most), at])
        s, i = np.concatenate([own_s.ravel(), score[at, col]]), np.concatenate([own_i.ravel(), ids[col]])
        order = np.lexsort((i, -s, rows))
        nth = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
        keep = order[nth < self.most]
        self.score[which], self.id[which] = s[keep].reshape(-1, self.most), i[keep].reshape(-1, self.most)

    def pairs(self, anchors: np.ndarray, negative: bool) -> pa.RecordBatch:
        """Each pair once, in how many lists of its anchor it may be."""
        at, n = np.nonzero(self.score > -np.inf)
        anchor, score, ids = anchors[at], self.score[at, n].astype(np.int64), self.id[at, n]
        order = np.lexsort((ids, anchor))
        anchor, score, ids = anchor[order], score[order], ids[order]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(score[new]), pa.array(np.full(int(new.sum()), negative)), pa.array(ids[new])], names=["anchor_id", "score", "is_negative", "id"])


def _windowed(score: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where((100 * score >= low[:, None]) & (100 * score <= high[:, None]), score, -np.inf)


class Cell:
    """Anchors of one cell, and what they have found so far. Without windows it looks for positives, else for negatives."""

    def __init__(self, windows: bool):
        self.windows = windows
        self.ids, self.labels, self.vectors, self.scores = [], [], [], []
        self.best: Best | None = None
        self.last: int | None = None

    def meet(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch["vec_id"].to_numpy())
        self.labels.append(batch["label"].to_numpy())
        self.vectors.append(_matrix(batch["v"]))
        self.scores.extend(batch["scores"].to_pylist() if self.windows else [[]] * batch.num_rows)

    def _open(self) -> None:
        self.anchor, self.label = np.concatenate(self.ids), np.concatenate(self.labels)
        m = np.zeros((len(self.anchor), max(v.shape[1] for v in self.vectors)))
        a = 0
        for v in self.vectors:
            m[a : a + len(v), : v.shape[1]] = v
            a += len(v)
        self.matrix = m
        self.of = np.repeat(np.arange(len(self.anchor)), [len(s) for s in self.scores])  # the anchor of each window
        ps = np.array([p for s in self.scores for p in s], float)
        self.low, self.high = LOW * ps, HIGH * ps
        self.best = Best(len(self.of), NEGATIVES) if self.windows else Best(len(self.anchor), POSITIVES)

    def score(self, batch: pa.RecordBatch) -> None:
        if not self.ids:
            return
        if self.best is None:
            self._open()
        ids = batch["vec_id"].to_numpy()
        first = np.append(ids[0] != self.last, ids[1:] != ids[:-1])  # rows come by id; an id counts once
        self.last = ids[-1]
        if not first.all():
            batch = batch.filter(pa.array(first))
        ids, labels, v = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["v"])
        for a in range(0, len(ids), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            s = _products(self.matrix, v[part])
            same, own = self.label[:, None] == labels[part], self.anchor[:, None] == ids[part]
            if not self.windows:
                self.best.add(np.where(same & ~own, s, -np.inf), ids[part])
                continue
            s[same | own] = np.nan
            for w in range(0, len(self.of), ANCHORS):
                to = slice(w, w + ANCHORS)
                self.best.add(_windowed(s[self.of[to]], self.low[to], self.high[to]), ids[part], to)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            yield self.best.pairs(self.anchor[self.of] if self.windows else self.anchor, self.windows)


def _cells(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, anchors first, then by id: pairs that can decide."""
    freed()
    now, cell = None, Cell(windows)
    for batch in batches:
        cells, anchor = batch["cell"].to_numpy(), batch["is_anchor"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(anchor.astype(int)) != 0)) + 1), len(cells)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if cells[a] != now:
                yield from cell.pairs()
                now, cell = cells[a], Cell(windows)
            (cell.meet if anchor[a] else cell.score)(batch.slice(a, b - a))
    yield from cell.pairs()


# ---- pairs in their deciding order -----------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, int]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _first_positives(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """anchor_id and the scores of its first positives."""
    ids: list[int] = []
    scores: list[list[int]] = []
    for anchor, score, _, _ in _groups(batches):
        if not ids or ids[-1] != anchor:
            if len(ids) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.list_(pa.int64()))], names=["anchor_id", "scores"])
                ids, scores = [], []
            ids.append(anchor)
            scores.append([])
        if len(scores[-1]) < most:
            scores[-1].append(score)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.list_(pa.int64()))], names=["anchor_id", "scores"])


def _mined(batches: Iterator[pa.RecordBatch], positives: int, negatives: int) -> Iterator[pa.RecordBatch]:
    """One pass over (anchor, score falling, positives first, id): the negatives of every window, in order."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    anchor = None
    opened, windows = 0, []
    for a, score, negative, row in _groups(batches):
        if a != anchor:
            anchor, opened, windows = a, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([row, score, 0])
            continue
        for w in windows:
            if w[2] < negatives and LOW * w[1] <= 100 * score <= HIGH * w[1]:
                w[2] += 1
                out.append((a, w[0], w[2], row, w[1], score))
        windows = [w for w in windows if w[2] < negatives and 100 * score >= LOW * w[1]]
        if len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "is_negative", "id")


# ---- the operator ----------------------------------------------------------------------------------------------------


def scaled(df: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v: the rows that take part, with each component x as floor(256 x)."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))


def mined(rows: DataFrame, is_anchor: Callable[[], Column]) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and v, integers as doubles. For each anchor and each of its first positives: the first
    negatives among those whose score lies within the window of the positive's.
    """
    rows = stored(rows, "negatives-rows", "zstd")
    n = rows.count()
    # Anchor blocks by hash: about ANCHORS each. Rows are dealt to as many shares as the table needs, and a few more tasks.
    anchors = rows.where(is_anchor()).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
    anchors = stored(anchors, "negatives-anchors", "zstd")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    shares = max(1, -(-n // SHARE), min(-(-n // AT_ONCE), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))
    block, share = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares))
    to_blocks, to_shares = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    streamed = rows.select("vec_id", "label", "v", share.alias("_s"), to_blocks.alias("_b")).select((F.col("_b") * shares + F.col("_s")).cast("long").alias("cell"), F.lit(False).alias("is_anchor"), "vec_id", "label", "v", F.array().cast("array<long>").alias("scores"))

    def cells(met: DataFrame, windows: bool) -> DataFrame:
        held = met.select("vec_id", "label", "v", "scores", block.alias("_b"), to_shares.alias("_s")).select((F.col("_b") * shares + F.col("_s")).cast("long").alias("cell"), F.lit(True).alias("is_anchor"), "vec_id", "label", "v", "scores")
        dealt = held.union(streamed).repartition(min(blocks * shares, 1 << 20), "cell").sortWithinPartitions("cell", F.desc("is_anchor"), "vec_id", "label", "v")
        return dealt.mapInArrow(lambda b: _cells(b, windows), _PAIR)

    empty = F.array().cast("array<long>")
    positives = stored(cells(anchors.withColumn("scores", empty), False), "negatives-positives")
    scores = _sorted(positives).mapInArrow(lambda b: _first_positives(b, POSITIVES), "anchor_id long, scores array<long>")
    opened = anchors.join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    negatives = cells(opened, True)
    return _sorted(positives.union(negatives)).mapInArrow(lambda b: _mined(b, POSITIVES, NEGATIVES), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


MINED_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
