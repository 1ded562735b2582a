"""Language-model scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Spark counts words, then pairs of word ids, in shuffled parts. Each part is stored as a sorted array of hashes or pair
keys with its counts; per-word sums (context totals, how many pairs were seen once, twice, more often, and how many
words precede a word) are stored as arrays over word ids. Workers map these files into memory and look words up by
binary search, so a model may be larger than their memory.

A text's tokens are its words and one end token. P(w|v) = max(c(vw) - D(c(vw)), 0) / c(v.) + g(v) P(w) with the three
discounts estimated from counts of counts; P(w) is the same kind of estimate over distinct predecessors, interpolated
with the even distribution over the vocabulary and one unknown word. An unknown or never continued context leaves P(w).

Defined results: null text counts as empty (one end token); a null id counts as the empty string in the fold; rows
with equal or null ids are kept apart and all of them count; an empty table gives an empty result; without training
tokens every probability is 1; further columns are ignored. Texts of any length are read whole.

The files are opened by path, so the shared folder must be mounted as one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.shared import folder, local_path, stored

IS_WORD = W.byte_table(W.SPACE)
END = W.signed(W.mix(np.array([0xE0D], np.uint64)))[0]
#: Distinct keys that a counting task gathers before it adds equal ones up.
GATHER = 1 << 21
_SUMS = np.dtype([("total", "<i8"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4"), ("before", "<u4")])


# ---- tokens ----------------------------------------------------------------------------------------------------------


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, row offsets) for stretches of rows; every row ends with END."""
    data, offsets = W.bytes_of(column)
    for a, b in W.pieces(offsets):
        _, _, h, rows = W.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], IS_WORD)
        out = np.empty(len(h) + b - a, np.int64)
        at = rows + np.arange(b - a + 1)
        last = at[1:] - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = W.signed(h)
        out[last] = END
        yield a, b, out, at


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, inverse = np.unique(k, return_inverse=True)
    return u, np.bincount(inverse, c, len(u)).astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """(key, n) of this task's rows, each key about once."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held, limit = 0, GATHER
    for batch in batches:
        for piece in tokens(batch.column(0)):
            u, n = np.unique(keys_of(*piece[2:]), return_counts=True)
            keys.append(u)
            counts.append(n)
            held += len(u)
            if held > limit:
                u, n = _added(keys, counts)
                if len(u) > GATHER:
                    yield from _emitted(u, n)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [u], [n], len(u)
                    limit = 2 * GATHER
    if keys:
        yield from _emitted(*_added(keys, counts))


def _emitted(u: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)], pa.int64()), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["key", "n"])


def _sorted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of distinct keys and their sums, from rows (key, n) sorted by key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        if last is not None:
            k, n = np.append(last[0], k), np.append(last[1], n)
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sums = np.add.reduceat(n, first)
        k = k[first]
        last = (k[-1], sums[-1])
        if len(k) > 1:
            yield k[:-1], sums[:-1]
    if last is not None:
        yield np.array([last[0]], np.int64), np.array([last[1]], np.int64)


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        os.makedirs(folder, exist_ok=True)
        self.to = f"{folder}/{name}"
        self.own = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.f = open(self.own, "wb")  # noqa: SIM115

    def put(self, a: np.ndarray) -> None:
        self.f.write(a.tobytes())

    def done(self) -> None:
        self.f.close()
        os.replace(self.own, self.to)


# ---- dictionary ------------------------------------------------------------------------------------------------------


def _write_words(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    keys, counts = _File(to, f"word-{part}.key"), _File(to, f"word-{part}.n")
    size = total = 0
    for k, n in _sorted_sums(batches):
        keys.put(k.astype("<i8"))
        counts.put(n.astype("<i8"))
        size, total = size + len(k), total + int(n.sum())
    keys.done()
    counts.done()
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "size": pa.array([size], pa.int64()), "total": pa.array([total], pa.int64())})


def _mapped(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


class Dictionary:
    """Word hash -> id and count, from mapped files. Ids run through the parts, in the order of the hashes."""

    def __init__(self, folder: str, sizes: list[int]):
        self.parts = len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.keys = [_mapped(f"{folder}/word-{p}.key", "<i8") for p in range(self.parts)]
        self.counts = [_mapped(f"{folder}/word-{p}.n", "<i8") for p in range(self.parts)]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        u, inverse = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        part = np.mod(u, self.parts)
        for p in np.unique(part).tolist():
            mine, keys = np.flatnonzero(part == p), self.keys[p]
            if not len(keys):
                continue
            at = np.searchsorted(keys, u[mine])
            ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == u[mine])
            ids[mine[ok]] = self.first[p] + at[ok]
            counts[mine[ok]] = self.counts[p][at[ok]]
        return ids[inverse], counts[inverse]


# ---- pairs -----------------------------------------------------------------------------------------------------------


def pair_keys(ids: np.ndarray, rows: np.ndarray, begin: int) -> np.ndarray:
    """Key of each token and the one before it; ``begin`` stands before a row's first token."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[rows[:-1]] = begin
    return np.where((before < 0) | (ids < 0), -1, (before << 32) | (ids & 0xFFFFFFFF))


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> 32) * 31 + (key & 0xFFFFFFFF)) % parts


def _write_pairs(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    """Writes a part's pairs; yields, by word id, sums over the part: as a context, and as a second word."""
    part = TaskContext.get().partitionId()
    keys, counts, large = _File(to, f"pair-{part}.key"), _File(to, f"pair-{part}.n"), _File(to, f"pair-{part}.large")
    done = 0
    for k, n in _sorted_sums(batches):
        keys.put(k.astype("<i8"))
        counts.put(np.minimum(n, 255).astype(np.uint8))
        big = np.flatnonzero(n >= 255)
        large.put(np.stack([big + done, n[big]], axis=1).astype("<i8"))
        done += len(k)
        first, second = k >> 32, k & 0xFFFFFFFF
        u, inverse = np.unique(np.concatenate([first, second]), return_inverse=True)
        a, b = inverse[: len(k)], inverse[len(k) :]
        size = len(u)
        add = lambda at, w=None: pa.array(np.bincount(at, w, size).astype(np.int64), pa.int64())
        own = [pa.array(u, pa.int64()), add(a, n), add(a, n == 1), add(a, n == 2), add(a, n >= 3), add(b)]
        of_pairs = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays(own, names=["id", *_SUMS.names])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3, -4], pa.int64()), *[pa.array(of_pairs if c == "total" else [0] * 4, pa.int64()) for c in _SUMS.names]], names=["id", *_SUMS.names])
    for f in (keys, counts, large):
        f.done()


def _write_sums(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    """Writes per-word sums at their ids' places; yields how many words have 1, 2, 3, 4 predecessors, and all of them."""
    seen = np.zeros(5, np.int64)
    fd = os.open(f"{to}/sums", os.O_WRONLY)
    try:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.zeros(len(ids), _SUMS)
            for c in _SUMS.names:
                rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            seen[:4] += [int((rows["before"] == i).sum()) for i in (1, 2, 3, 4)]
            seen[4] += int(rows["before"].sum())
            if len(ids):
                for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):
                    os.pwrite(fd, rows[run].tobytes(), int(ids[run[0]]) * _SUMS.itemsize)
    finally:
        os.close(fd)
    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in seen], names=["n1", "n2", "n3", "n4", "pairs"])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more, from how many counts are 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    fit = lambda d, most: min(max(d, 0.05), most)
    return (fit(d1, 0.95), fit(d2, 1.95), fit(d3, 2.95))


class Model:
    """Mapped files of a trained model; opened once per worker."""

    _open: dict[str, Model] = {}

    def __init__(self, spec: dict):
        self.words = Dictionary(spec["folder"], spec["sizes"])
        self.begin = int(self.words.first[-1])
        self.n, self.v = spec["n"], self.begin
        self.parts = spec["parts"]
        self.sums = _mapped(f"{spec['folder']}/sums", _SUMS)
        self.pairs = [_mapped(f"{spec['folder']}/pair-{p}.key", "<i8") for p in range(self.parts)]
        self.counts = [_mapped(f"{spec['folder']}/pair-{p}.n", np.uint8) for p in range(self.parts)]
        self.large = [_mapped(f"{spec['folder']}/pair-{p}.large", "<i8").reshape(-1, 2) for p in range(self.parts)]
        self.d2, self.d1, self.n_pairs = spec["pair_discounts"], spec["word_discounts"], spec["n_pairs"]
        self.d1_by = np.array([0.0, *self.d1])
        self.d2_by = np.array([0.0, *self.d2])
        n = spec["word_kinds"]
        left = self.d1[0] * n[0] + self.d1[1] * n[1] + self.d1[2] * max(0, self.v - n[0] - n[1])
        self.spread = (min(1.0, left / self.n_pairs) if self.n_pairs else 1.0) / (self.v + 1)

    @classmethod
    def of(cls, spec: dict) -> Model:
        if spec["folder"] not in cls._open:
            cls._open = {spec["folder"]: cls(spec)}
        return cls._open[spec["folder"]]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        u, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros(len(u), np.int64)
        part = np.where(u < 0, -1, _part_of(u, self.parts))
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in range(self.parts):
            mine, own = order[cuts[p] : cuts[p + 1]], self.pairs[p]
            if not len(mine) or not len(own):
                continue
            at = np.searchsorted(own, u[mine])
            at[at == len(own)] = 0
            ok = own[at] == u[mine]
            n = self.counts[p][at].astype(np.int64)
            big = ok & (n == 255)
            if big.any():
                n[big] = self.large[p][np.searchsorted(self.large[p][:, 0], at[big]), 1]
            out[mine] = np.where(ok, n, 0)
        return out[inverse]

    def scores(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its training count, and the base and the model's log10 probability."""
        ids, c = self.words.look(h)
        base = np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))
        known = ids >= 0
        own = np.zeros(len(ids), _SUMS)
        own[known] = self.sums[ids[known]]
        before = own["before"].astype(np.float64)
        p = np.maximum(0, before - self.d1_by[np.minimum(own["before"], 3)]) / max(1, self.n_pairs) + self.spread
        keys = pair_keys(ids, rows, self.begin)
        v = np.empty(len(ids), np.int64)
        v[1:] = ids[:-1]
        v[rows[:-1]] = self.begin
        context = np.zeros(len(ids), _SUMS)
        if len(self.sums):
            context[v >= 0] = self.sums[v[v >= 0]]
        n = self.pair_counts(keys)
        total = np.maximum(1, context["total"])
        free = (self.d2[0] * context["once"] + self.d2[1] * context["twice"] + self.d2[2] * context["more"]) / total
        seen = context["total"] > 0
        p = np.where(seen, np.maximum(0, n - self.d2_by[np.minimum(n, 3)]) / total + free * p, p)
        return c, base, np.log10(p)


# ---- training and scoring --------------------------------------------------------------------------------------------


def train(docs: DataFrame, text: str = "text") -> dict:
    """Count ``docs`` into files in the shared folder; returns the small description that ``Model`` needs."""
    spark = docs.sparkSession
    to = local_path(folder(spark, "lm"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(lambda b: _counting(b, lambda h, rows: h), "key long, n long")
    placed = counted.repartitionById(parts, F.pmod("key", F.lit(parts)).cast("int")).sortWithinPartitions("key")
    made = {r["part"]: r for r in stored(placed.mapInArrow(lambda b: _write_words(b, to), "part int, size long, total long"), "lm-words").collect()}  # one row per part
    sizes = [made[p]["size"] if p in made else 0 for p in range(parts)]
    for p in range(parts):
        if p not in made:
            for kind in ("key", "n"):
                os.makedirs(to, exist_ok=True)
                open(f"{to}/word-{p}.{kind}", "ab").close()
    v, n = sum(sizes), sum(r["total"] for r in made.values())
    if v >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")

    def keys_of(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        own = _words_of(to, sizes)
        return pair_keys(own.look(h)[0], rows, int(own.first[-1]))

    pairs = texts.mapInArrow(lambda b: _counting(b, keys_of), "key long, n long")
    part = F.pmod(F.shiftright("key", 32) * 31 + F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(parts)).cast("int")
    placed = pairs.repartitionById(parts, part).sortWithinPartitions("key")
    sums = placed.mapInArrow(lambda b: _write_pairs(b, to), "id long, " + ", ".join(f"{c} long" for c in _SUMS.names))
    sums = stored(sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in _SUMS.names]), "lm-sums")
    kinds = {r["id"]: r["total"] for r in sums.where("id < 0").collect()}  # four rows
    for p in range(parts):
        for kind in ("key", "n", "large"):
            if not os.path.exists(f"{to}/pair-{p}.{kind}"):
                open(f"{to}/pair-{p}.{kind}", "ab").close()
    with open(f"{to}/sums", "wb") as f:
        f.truncate((v + 1) * _SUMS.itemsize)
    chunk = -(-(v + 1) // parts)
    dense = sums.where("id >= 0").repartitionById(parts, F.floor(F.col("id") / chunk).cast("int")).sortWithinPartitions("id")
    got = dense.mapInArrow(lambda b: _write_sums(b, to), "n1 long, n2 long, n3 long, n4 long, pairs long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "pairs")]).first()
    word_kinds = [got[f"n{i}"] for i in (1, 2, 3, 4)]
    return {"folder": to, "sizes": sizes, "parts": parts, "n": n, "n_pairs": got["pairs"], "pair_discounts": discounts([kinds.get(-i, 0) for i in (1, 2, 3, 4)]), "word_discounts": discounts(word_kinds), "word_kinds": word_kinds}


_dictionaries: dict[str, Dictionary] = {}


def _words_of(to: str, sizes: list[int]) -> Dictionary:
    if to not in _dictionaries:
        _dictionaries.clear()
        _dictionaries[to] = Dictionary(to, sizes)
    return _dictionaries[to]


def _scored(batches: Iterator[pa.RecordBatch], spec: dict) -> Iterator[pa.RecordBatch]:
    model = Model.of(spec)
    names = ["n_tokens", "n_known", "base_score", "score"]
    for batch in batches:
        out: dict[str, list[np.ndarray]] = {k: [] for k in names}
        for _, _, h, rows in tokens(batch.column(batch.num_columns - 1)):
            c, base, p = model.scores(h, rows)
            out["n_tokens"].append(np.diff(rows))
            out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), rows[:-1]))
            out["base_score"].append(np.add.reduceat(base, rows[:-1]))
            out["score"].append(np.add.reduceat(p, rows[:-1]))
        arrays = [pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0), pa.int64() if k[0] == "n" else pa.float64()) for k in names]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *names])


def score(docs: DataFrame, spec: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, base_score and score (log10) of each row."""
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(lambda b: _scored(b, spec), head + "n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def cross_scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not held out; score all rows."""
    fold = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    spec = train(fold.where("NOT held_out"))
    out = score(fold, spec, ["doc_id", "held_out"])
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(spec["n"]).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
