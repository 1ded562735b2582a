"""Exact neighbours over pivots: nearest rows, rows within a distance, and density clusters.

A bounded number of rows, drawn by hash, are pivots; every row belongs to the cell of its nearest pivot. For a row x and a
cell with pivot q whose rows lie at distances lo..hi from q, no row of the cell is nearer to x than

    max(d(x, q) - hi, lo - d(x, q), (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)))

with p the pivot of x (the last bound is the distance to the plane between the two cells). So x meets only the cells that
may hold a row within its own reach: eps, or the distance of the k-th neighbour found in its own cell, which is searched
first. Where data has clusters, most cells are ruled out; where it has none, a row meets all cells, of which there is one
for about ``CELL`` rows.

Rows are dealt once in blocks, a cell or a part of one, and pairs of partitions of blocks meet as a Cartesian product that
reads them where they lie: nothing is sent to each cell that is met, so disk grows with the rows and not with the pairs, and
a task holds a partition of bounded size on one side and goes through one on the other. A task keeps what it has found for a row (the k nearest, a count, the joined rows) while it goes on from block to block, so
what leaves it grows with the rows of a partition and not with the pairs either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.operators.graph import components
from tabguard.operators.ranks import hashed_order
from tabguard.sources.tables import stored

#: Rows of a cell or part of a cell, and the most pivots (their vectors go to every task).
CELL, PIVOTS = 2048, 4096
#: Bytes of a partition of blocks: of the side that a task goes through, and of the side that it holds.
PASSED, HELD = 1 << 22, 1 << 25
#: Bytes of pairs of blocks that go to Python at once.
SENT = 1 << 23
#: Bounds are wrong by rounding only.
SLACK = 1e-9


def _rows(column: pa.Array, p: int) -> np.ndarray:
    """Rows of a list column of ``p`` numbers each, without a Python object per number."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([pa.array([], column.type), *column.chunks])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), p)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _exact_squared(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        out[part] = ((x[i[part]] - y[j[part]]) ** 2).sum(1)
    return out


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.sqrt(_exact_squared(x, y, i, j))


class Cells:
    """Pivots of ``others``, its rows in their cells and parts, and which cells a row must visit."""

    def __init__(self, others: DataFrame, features: list[str], key: str, cell: int = CELL):
        self.features, self.key, self.cell = features, key, cell
        n = others.count()
        drawn = others.orderBy(hashed_order([key], 17), key).limit(max(1, min(PIVOTS, -(-n // cell)))).select(self._vector())
        self.pivots = np.array([r[0] for r in drawn.collect()], float).reshape(-1, len(features))  # at most PIVOTS rows
        self.rows = stored(self.assigned(others), "cells")
        got = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()  # a row per pivot
        m = len(self.pivots)
        self.n, self.lo, self.hi = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
        for r in got:
            self.n[r["cell"]], self.lo[r["cell"]], self.hi[r["cell"]] = r["n"], r["lo"], r["hi"]
        self.between = np.sqrt(_squared(self.pivots, self.pivots))

    def _vector(self):
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]).alias("x")

    def assigned(self, df: DataFrame) -> DataFrame:
        """key, x, cell and d, the distance to the cell's pivot."""
        pivots, p = self.pivots, len(self.features)

        def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch.column(1), p)
                at, d = np.zeros(len(x), np.int32), np.zeros(len(x))
                for a in range(0, len(x), 1024):
                    part = slice(a, a + 1024)
                    at[part] = _squared(x[part], pivots).argmin(1)
                    d[part] = np.sqrt(((x[part] - pivots[at[part]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(d)], names=["key", "x", "cell", "d"])

        kind = dict(df.dtypes)[self.key]
        return df.select(F.col(self.key).alias("key"), self._vector()).mapInArrow(nearest_pivot, f"key {kind}, x array<double>, cell int, d double") if len(pivots) else df.sparkSession.createDataFrame([], f"key {kind}, x array<double>, cell int, d double")

    def _bound(self, x: np.ndarray, d: np.ndarray, cell: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What no row of the cells ``to`` is nearer than to rows of one cell, and the distances to their pivots."""
        away = np.sqrt(_squared(x, self.pivots[to]))
        away[:, to == cell] = d[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((away**2 - (d**2)[:, None]) / (2 * self.between[cell, to]), nan=0.0, posinf=0.0, neginf=0.0)
        return np.maximum(np.maximum(away - self.hi[to], self.lo[to] - away), plane), away

    def may(self, x: np.ndarray, d: np.ndarray, reach: np.ndarray, cell: int, to: np.ndarray) -> np.ndarray:
        """Whether each of the cells ``to`` may hold a row within ``reach`` of x: rows of one cell, ``d`` from its pivot."""
        bound, away = self._bound(x, d, cell, to)
        return ((bound <= reach[:, None] + SLACK * (1 + away)) & (self.n[to] > 0)) | (to == cell)

    def visits(self, rows: DataFrame, own: bool) -> DataFrame:
        """key, to: a row for each cell that may hold a row within ``reach`` of x; without its own cell unless ``own``."""
        p, every, bare = len(self.features), np.arange(len(self.pivots)), self._bare()

        def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cell = _rows(batch.column(1), p), batch.column(2).to_numpy()
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    go = bare.may(x[at], batch.column(3).to_numpy()[at], batch.column(4).to_numpy(zero_copy_only=False)[at], c, every)
                    go[:, c] &= own
                    i, j = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i])), pa.array(j.astype(np.int32))], names=["key", "to"])

        return rows.select("key", "x", "cell", "d", "reach").mapInArrow(which, f"key {dict(rows.dtypes)['key']}, to int")

    def _bare(self) -> Cells:
        """Without the rows, for tasks."""
        bare = object.__new__(Cells)
        bare.__dict__ = {k: v for k, v in self.__dict__.items() if k != "rows"}
        return bare

    def blocks(self, rows: DataFrame, visit: str | None = None) -> DataFrame:
        """``rows`` (key, x, cell, d; reach, core) in blocks of a cell's rows; with the cells ``to`` meet (home, away or all) to be passed, without to be held."""
        spark, cell, p, bare, every = rows.sparkSession, self.cell, len(self.features), self._bare(), np.arange(len(self.pivots))
        n = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
        parts = [(c, -(-k // cell)) for c, k in n.items()]
        table = F.broadcast(spark.createDataFrame(parts, "cell int, parts int"))
        deal = -(-sum(n.values()) * (8 * p + 32) // (PASSED if visit else HELD))
        if visit:
            deal = max(deal, min(sum(k for _, k in parts), spark.sparkContext.defaultParallelism))
        extra = [c for c in ("reach", "core") if c in rows.columns]
        placed = rows.join(table, "cell").withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int")).select("cell", "part", "key", "x", "d", *extra)

        def build(t: pa.Table) -> pa.Table:
            x, d, at = _rows(t["x"], p), t["d"].to_numpy(), t["cell"][0].as_py()
            reach = t["reach"].to_numpy() if "reach" in extra else np.full(len(x), np.inf)
            core = t["core"].to_numpy() if "core" in extra else np.ones(len(x), bool)
            if visit == "home":
                to = np.array([at])
            elif visit:
                go = np.zeros(len(every), bool)
                for a in range(0, len(x), 512):
                    part = slice(a, a + 512)
                    go |= bare.may(x[part], d[part], reach[part], at, every).any(0)
                go[at] &= visit == "all"
                to = np.flatnonzero(go)
            else:
                to = np.zeros(0, int)
            keys = pa.concat_arrays(t["key"].chunks)
            whole = [pa.array([v.tobytes()], pa.binary()) for v in (x, d, reach, core)]
            return pa.table([t["cell"].slice(0, 1), t["part"].slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *whole, pa.array([to.tolist()], pa.list_(pa.int32()))], names=_BLOCK)

        built = placed.groupBy("cell", "part").applyInArrow(build, f"cell int, part int, keys array<{dict(rows.dtypes)['key']}>, x binary, d binary, reach binary, core binary, `to` array<int>")
        return built.repartition(max(1, deal))


_BLOCK = ["cell", "part", "keys", "x", "d", "reach", "core", "to"]


@dataclass
class Block:
    """Rows of a cell: their keys, vectors, distances from the pivot, reach, and whether they are core rows."""

    at: tuple[int, int]
    keys: pa.Array
    x: np.ndarray
    d: np.ndarray
    reach: np.ndarray
    core: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, i: int, first: int, p: int) -> Block:
        cell, part, keys, x, d, reach, core = (batch.column(first + k)[i] for k in range(7))
        numbers = [np.frombuffer(v.as_buffer(), kind) for v, kind in ((x, float), (d, float), (reach, float), (core, bool))]
        return Block((cell.as_py(), part.as_py()), keys.values, numbers[0].reshape(-1, p), *numbers[1:])


def _met(left: DataFrame, right: DataFrame, meet: Callable, result: str) -> DataFrame:
    """``meet`` over the pairs of blocks whose left one asks for the cell of the right one, stored; those of a left one follow each other in a task."""
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in _BLOCK[:-1]])
    both = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("to", F.col("r_cell"))).drop("to")
    conf, name = left.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, str(SENT))
    try:
        return stored(both.mapInArrow(meet, result), "met")
    finally:
        conf.set(name, before)


def _pairs_of(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[Block, Block]]:
    for batch in batches:
        for i in range(len(batch)):
            yield Block.of(batch, i, 0, p), Block.of(batch, i, 7, p)


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, squared distances of up to 512 rows of x from all of y, and what rounding may have put on them."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    a, b = np.column_stack([x, np.ones(len(x)), xx]), np.column_stack([-2 * y, yy, np.ones(len(y))]).T
    off = 1e-12 * (xx + yy.max(initial=0.0))
    for i in range(0, len(x), 512):
        yield i, a[i : i + 512] @ b, off[i : i + 512]


# ---- nearest rows ----------------------------------------------------------------------------------------------------


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def nearest(df: DataFrame, others: DataFrame, features: list[str], key: str, k: int, cell: int = CELL) -> DataFrame:
    """key, nth, other, distance: the k nearest rows of ``others`` (without the row itself), exact; nulls count as 0."""
    cells, p = Cells(others, features, key, cell), len(features)
    mine = stored(cells.assigned(df), "cells")
    kind, bare = dict(others.dtypes)[key], cells._bare()

    def among(block: Block, own: np.ndarray, bar: np.ndarray, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among a row's k nearest: within its bar, or without one within its k-th distance here."""
        i, j = [np.zeros(0, int)], [np.zeros(0, int)]
        m = min(k + 1, len(other.x))  # one more, for the row itself
        for a, d, off in _tiles(block.x[own], other.x):
            top = bar[a : a + 512].copy()
            bare_rows = np.flatnonzero(np.isinf(top))
            if len(bare_rows):
                top[bare_rows] = np.maximum(np.partition(d[bare_rows], m - 1, axis=1)[:, m - 1], 0)
            # With equal distances, and rounding in them, at the m-th place all that may be among the first go on.
            hit = np.flatnonzero(d <= (top * (1 + SLACK) + 2 * off)[:, None])
            i.append(own[hit // len(other.x) + a])
            j.append(hit % len(other.x))
        return np.concatenate(i), np.concatenate(j)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, reach = None, None, None

        def best() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([block.keys.take(pa.array(found[0])), pa.array(found[2], block.keys.type), pa.array(found[1])], names=["key", "other", "distance"])

        for mine, other in _pairs_of(batches, p):
            if block is None or mine.at != block.at:
                if block is not None:
                    yield best()
                ids = mine.keys.to_numpy(zero_copy_only=False)
                block, reach, found = mine, mine.reach.copy(), (np.zeros(0, int), np.zeros(0), ids[:0])
            own = np.flatnonzero(bare.may(block.x, block.d, reach, block.at[0], np.array([other.at[0]]))[:, 0])
            if not len(own):
                continue
            i, j = among(block, own, reach[own] ** 2, other)
            theirs = other.keys.to_numpy(zero_copy_only=False)
            ok = ids[i] != theirs[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            i, d, o = np.concatenate([found[0], i]), np.concatenate([found[1], _exact(block.x, other.x, i, j)]), np.concatenate([found[2], theirs[j]])
            order = np.lexsort((o, d, i))
            i, d, o = i[order], d[order], o[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            reach[i[nth == k - 1]] = np.minimum(reach[i[nth == k - 1]], d[nth == k - 1])
            found = i[nth < k], d[nth < k], o[nth < k]
        if block is not None:
            yield best()

    result = f"key {kind}, other {kind}, distance double"
    w = Window.partitionBy("key").orderBy("distance", "other")
    best = lambda df: df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    theirs = cells.blocks(cells.rows)
    home = stored(best(_met(cells.blocks(mine, "home"), theirs, meet, result)), "neighbours")
    reach = home.where(F.col("nth") == k).select("key", F.col("distance").alias("reach"))
    rest = stored(mine.join(reach, "key", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), "cells")
    away = _met(cells.blocks(rest, "away"), theirs, meet, result)
    return best(home.drop("nth").union(away)).select("key", "nth", "other", "distance")


# ---- rows within a distance ------------------------------------------------------------------------------------------


def _pairs(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within eps; those that rounding could put on either side are measured again."""
    for a, d, off in _tiles(x, y):
        i, j = np.divmod(np.flatnonzero(d <= (eps * eps * (1 + 1e-6) + 1e-9 + off)[:, None]), len(y))
        close = np.flatnonzero(d[i, j] >= (eps * eps * (1 - 1e-6) - 1e-9 - off)[i])
        i += a
        keep = np.ones(len(i), bool)
        keep[close] = _exact_squared(x, y, i[close], j[close]) <= eps * eps
        yield i[keep], j[keep]


def neighbour_counts(df: DataFrame, features: list[str], key: str, eps: float, cell: int = CELL, cells: Cells | None = None) -> DataFrame:
    """key, n: how many rows lie within eps, the row itself counted."""
    cells = cells or Cells(df, features, key, cell)
    p, bare = len(features), cells._bare()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = None, None
        for mine, other in _pairs_of(batches, p):
            if block is None or mine.at != block.at:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([block.keys, pa.array(n)], names=["key", "n"])
                block, n = mine, np.zeros(len(mine.x), np.int64)
            own = np.flatnonzero(bare.may(block.x, block.d, block.reach, block.at[0], np.array([other.at[0]]))[:, 0])
            for i, _ in _pairs(block.x[own], other.x, eps):
                n[own] += np.bincount(i, minlength=len(own))
        if block is not None:
            yield pa.RecordBatch.from_arrays([block.keys, pa.array(n)], names=["key", "n"])

    rows = cells.rows.withColumn("reach", F.lit(float(eps)))
    return _met(cells.blocks(rows, "all"), cells.blocks(rows), meet, f"key {dict(df.dtypes)[key]}, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the nodes 0..n-1 as these pairs do, fewer than n: each node to the least of its component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def density_edges(df: DataFrame, features: list[str], key: str, eps: float, least: int, links: bool = True, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """key, n, core of every row; and edges a, b, is_core: of core rows to core rows, as many as join what lies within eps
    (only if ``links``), and of other rows to a core row for each cluster within eps, as far as a task knows them."""
    cells, p = Cells(df, features, key, cell), len(features)
    kind, bare = dict(df.dtypes)[key], cells._bare()
    counts = stored(neighbour_counts(df, features, key, eps, cell, cells).withColumn("core", F.col("n") >= least), "counts")
    marked = stored(cells.rows.join(counts.select("key", "core"), "key").withColumn("reach", F.lit(float(eps))), "cells")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning forest over the core rows that a task meets, and other rows' core neighbours, one for each of its trees."""
        first, keys, size = {}, [], 0  # blocks of either side are the same rows: a node for each
        joined, border, many = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], 0

        def node(block: Block) -> int:
            nonlocal size
            if block.at not in first:
                first[block.at] = size
                keys.append(block.keys)
                size += len(block.keys)
            return first[block.at]

        def pressed() -> None:
            nonlocal joined, border, many
            e, o = np.concatenate(joined), np.concatenate(border)
            child, root = _forest(size, e[:, 0], e[:, 1])
            label = np.arange(size)
            label[child] = root
            joined, border = [np.column_stack([child, root])], [np.unique(np.column_stack([o[:, 0], label[o[:, 1]]]), axis=0)]
            many = len(joined[0]) + len(border[0])

        bar = 1 << 21
        for mine, other in _pairs_of(batches, p):
            theirs = np.flatnonzero(other.core)
            go = bare.may(mine.x, mine.d, mine.reach, mine.at[0], np.array([other.at[0]]))[:, 0]
            if not links or mine.at > other.at:  # two core rows meet from one side only
                go &= ~mine.core
            own = np.flatnonzero(go)
            if not len(own) or not len(theirs):
                continue
            a, b = node(mine), node(other)
            for i, j in _pairs(mine.x[own], other.x[theirs], eps):
                i, j = own[i], theirs[j]
                both = mine.core[i]
                child, root = _forest(len(mine.x) + len(other.x), i[both], len(mine.x) + j[both])
                e = np.column_stack([child, root])
                joined.append(np.where(e < len(mine.x), a + e, b + e - len(mine.x)))
                label = np.arange(len(mine.x) + len(other.x))
                label[child] = root
                o = np.unique(np.column_stack([i[~both], label[len(mine.x) + j[~both]]]), axis=0) if (~both).any() else np.zeros((0, 2), np.int64)
                border.append(np.column_stack([a + o[:, 0], np.where(o[:, 1] < len(mine.x), a + o[:, 1], b + o[:, 1] - len(mine.x))]))
                many += len(e) + len(o)
            if many > bar:
                pressed()
                bar = max(bar, 2 * many)
        if not keys:
            return
        pressed()
        every = pa.concat_arrays(keys)
        for e, is_core in ((joined[0], True), (border[0], False)):
            yield pa.RecordBatch.from_arrays([every.take(pa.array(e[:, 0])), every.take(pa.array(e[:, 1])), pa.array(np.full(len(e), is_core))], names=["a", "b", "is_core"])

    return counts, _met(cells.blocks(marked, "all"), cells.blocks(marked), meet, f"a {kind}, b {kind}, is_core boolean")


def density_noise(df: DataFrame, features: list[str], key: str, eps: float, least: int, cell: int = CELL) -> DataFrame:
    """key, noise: not a core row, and without one within eps."""
    counts, edges = density_edges(df, features, key, eps, least, False, cell)
    near = edges.select(F.col("a").alias("key")).distinct().withColumn("near", F.lit(True))
    return counts.join(near, "key", "left").select("key", (~F.col("core") & F.col("near").isNull()).alias("noise"))


def density_clusters(df: DataFrame, features: list[str], key: str, eps: float, least: int, cell: int = CELL) -> DataFrame:
    """key, n, core, noise, cluster.

    A core row has ``least`` rows within eps, itself counted. Core rows within eps of each other are one cluster, named by
    its least core row; another row belongs to the least cluster of its core neighbours; a row without one is noise.
    """
    counts, edges = density_edges(df, features, key, eps, least, True, cell)
    core = counts.where("core").select("key")
    joined = stored(components(edges.where("is_core").select("a", "b")), "clusters")
    of_core = stored(core.join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("cluster")), "clusters")
    border = edges.where("NOT is_core").select(F.col("a").alias("row"), F.col("b").alias("key")).join(of_core, "key").groupBy("row").agg(F.min("cluster").alias("cluster")).withColumnRenamed("row", "key")
    of_row = of_core.union(border)
    return counts.join(of_row, "key", "left").select("key", "n", "core", F.col("cluster").isNull().alias("noise"), "cluster")
