"""Suffix-array deduplication of long byte strings with longest-previous-factor arrays.

Every document is a string of bytes. A byte goes if a stretch of ``SIZE`` bytes that covers it also starts in a document
with a smaller id. In suffix order the earlier documents that share most with a suffix are the nearest ones before and
behind it that are smaller (previous and next smaller positions); the longer of the two common prefixes is its longest
previous factor, and where that reaches ``SIZE``, the stretch from this suffix on is a later copy.

The suffixes of a corpus are sorted in buckets. Every stretch of ``SIZE`` bytes is named by its anchor, the least of its
KMER-byte strings in a fixed pseudo-random order, so equal stretches meet in the bucket of their anchor, and neighbouring
stretches mostly share one and travel as one string (a run). Three steps:

1. Documents are packed into segments of a few megabytes, written once. Every segment sends four bytes of each distinct
   anchor to the anchor's bucket, which answers with a bit: whether another segment has it. Most anchors end here.
2. Segments send the runs of the other anchors, each distinct run once with its least document. A bucket merges equal runs
   of all segments; then it sorts the suffixes that start in them, scans for previous and next smaller positions and
   returns to each segment the stretches that are later copies. Comparison is of bytes; hashes only bring equals together.
3. Segments mark the covered bytes and hash what is left. A document longer than a segment is cut into pieces that overlap,
   which are put together again by a secondary sort, with no more than one piece in memory.

What a segment sends for a passage does not grow with how many of its documents have it, so a passage that a third of all
documents share comes once from each segment.

Defined results: null text is empty; a null id is greater than all others; rows with equal or both null ids do not remove
from each other; texts under ``SIZE`` bytes lose nothing; an empty table gives an empty result; further columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.shared import dropped, freed, stored

SIZE, KMER = 50, 16
#: Stretches that an anchor is drawn from, which is also the most that one run holds.
SPAN = SIZE - KMER + 1
WIDE = SPAN + SIZE - 1
#: Bytes of a segment, bytes of the corpus for a bucket, stretches handled at once.
SEGMENT, BUCKET, CHUNK = 1 << 22, 1 << 20, 1 << 17
NONE = np.iinfo(np.int64).max
_ZSTD = pa.Codec("zstd", compression_level=1)
_BASE = 0x9E3779B97F4A7C15


# ---- segments --------------------------------------------------------------------------------------------------------

_SEGMENT = "segment long, long_row long, piece int, own long, ids array<long>, ends array<long>, size long, text binary"


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    freed()
    schema = pa.schema([("segment", pa.int64()), ("long_row", pa.int64()), ("piece", pa.int32()), ("own", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("size", pa.int64()), ("text", pa.binary())])
    base = TaskContext.get().partitionId() << 33
    n = 0

    def row(ids: list, ends: list[int], text: bytes, long_row: int | None = None, piece: int = 0, own: int | None = None) -> pa.RecordBatch:
        nonlocal n
        n += 1
        values = [base + n, long_row, piece, len(text) if own is None else own, ids, ends, len(text), _ZSTD.compress(text, asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    ids, ends, parts, size = [], [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if len(text) > most:
                long_row = base + n + 1
                for p, a in enumerate(range(0, len(text), most)):
                    part = text[a : a + most + SIZE - 1]
                    yield row([i], [len(part)], part, long_row, p, min(most, len(text) - a))
                continue
            if size + len(text) > most:
                yield row(ids, ends, b"".join(parts))
                ids, ends, parts, size = [], [], [], 0
            size += len(text)
            ids.append(i)
            ends.append(size)
            parts.append(text)
    if ids:
        yield row(ids, ends, b"".join(parts))


class Segment:
    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch[name][i].as_py()
        self.segment, self.long_row, self.own, self.ids = get("segment"), get("long_row"), get("own"), get("ids")
        size = get("size")
        self.data = np.frombuffer(_ZSTD.decompress(batch["text"][i].as_buffer(), size), np.uint8) if size else np.zeros(0, np.uint8)
        self.offsets = np.array([0, *get("ends")], np.int64)
        self.keys = np.array([NONE if k is None else k for k in self.ids], np.int64)

    def runs(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of stretches and anchor of every run of stretches with one anchor."""
        n = len(self.data) - SIZE + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # Stretches that would cross the end of a document are none.
        cross = np.zeros(n + 1, np.int32)
        inner = self.offsets[1:-1]
        np.add.at(cross, np.clip(inner - SIZE + 1, 0, n), 1)
        np.add.at(cross, np.clip(inner, 0, n), -1)
        inside = np.cumsum(cross[:-1]) == 0
        starts, counts, anchors = [], [], []
        for a in range(0, n, chunk):
            least = _least(_hashed(self.data[a : a + chunk + SIZE - 1], KMER), SPAN)
            ok = inside[a : a + len(least)]
            at = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])))
            count = np.diff(np.append(at, len(least)))
            at, count = at[ok[at]], count[ok[at]]
            cut = -(-count // SPAN)
            if cut.max(initial=1) > 1:  # an anchor that follows itself
                nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
                at, count = np.repeat(at, cut) + nth * SPAN, np.minimum(np.repeat(count, cut) - nth * SPAN, SPAN)
            starts.append(at + a)
            counts.append(count)
            anchors.append(least[at])
        return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def _hashed(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each byte on."""
    one, length, power = W.EXACT[data], 1, _BASE
    out, done = None, 0
    while True:
        if size & length:
            if out is None:
                out, done = one, length
            else:
                m = len(data) - done - length + 1
                out = out[:m] * np.uint64(power) + one[done : done + m]
                done += length
        if 2 * length > size:
            break
        one = one[:-length] * np.uint64(power) + one[length:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        length *= 2
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` values from each on."""
    n, length = len(h) - size + 1, 1
    while 2 * length <= size:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return np.minimum(h[:n], h[size - length : size - length + n])


def _by_bucket(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket, the buckets that occur, and where each begins and ends."""
    bucket = (anchors >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    return order, bucket[begin].astype(np.int64), begin, np.append(begin[1:], len(bucket))[: len(begin)]


# ---- first step: which anchors do several segments have? -------------------------------------------------------------


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int, chunk: int) -> Iterator[pa.RecordBatch]:
    freed()
    for batch in batches:
        for i in range(batch.num_rows):
            s = Segment(batch, i)
            u = np.unique(s.runs(chunk)[2])
            order, bucket, begin, end = _by_bucket(u, buckets)
            low = (u[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), s.segment)), pa.array([low[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())], names=["bucket", "segment", "data"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows of one bucket at a time, from rows sorted by it."""
    now, segments, data = None, [], []
    for batch in batches:
        for b, s, d in zip(batch["bucket"].to_pylist(), batch["segment"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if b != now:
                if segments:
                    yield now, segments, data
                now, segments, data = b, [], []
            segments.append(s)
            data.append(d)
    if segments:
        yield now, segments, data


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    freed()
    for bucket, segments, data in _buckets(batches):
        low = np.frombuffer(b"".join(data), np.uint32)
        _, of, n = np.unique(low, return_inverse=True, return_counts=True)
        several = n[of] > 1
        ends = np.cumsum([len(d) // 4 for d in data])
        bits = [np.packbits(several[b - len(d) // 4 : b]).tobytes() for b, d in zip(ends, data, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array([bucket] * len(segments), pa.int64()), pa.array(bits, pa.binary())], names=["segment", "bucket", "bits"])


# ---- second step: runs of these anchors, and the suffixes that start in them -----------------------------------------


def _rows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run's bytes per row, and which of them it has."""
    at = starts[:, None] + np.arange(WIDE)
    return data[np.minimum(at, max(len(data) - 1, 0))], np.arange(WIDE) < sizes[:, None]


def _distinct(hashes: np.ndarray, rows: np.ndarray, has: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (run, key), and where in it a new run begins."""
    order = np.lexsort((keys, hashes))
    if not len(order):
        return order, np.zeros(0, bool)
    r, m = rows[order], has[order]
    same = (hashes[order][1:] == hashes[order][:-1]) & (m[1:] == m[:-1]).all(axis=1) & ((r[1:] == r[:-1]) | ~m[1:]).all(axis=1)
    return order, np.append(True, ~same)


def _encoded(starts: np.ndarray, counts: np.ndarray) -> bytes:
    return starts.astype(np.uint32).tobytes() + counts.astype(np.uint8).tobytes()


def _decoded(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of runs of stretches, from any number of ``_encoded``."""
    n = [len(b) // 5 for b in blobs]
    starts = np.frombuffer(b"".join(b[: 4 * k] for b, k in zip(blobs, n, strict=True)), np.uint32).astype(np.int64)
    return starts, np.frombuffer(b"".join(b[4 * k :] for b, k in zip(blobs, n, strict=True)), np.uint8).astype(np.int64)


def _candidates(batches: Iterator[pa.RecordBatch], buckets: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """bucket, segment, data (runs with their least document) and known (stretches with an earlier copy in the segment)."""
    freed()
    for batch in batches:
        for i in range(batch.num_rows):
            s = Segment(batch, i)
            start, count, anchor = s.runs(chunk)
            u, of = np.unique(anchor, return_inverse=True)
            doc = np.searchsorted(s.offsets, start, side="right") - 1
            key = s.keys[doc] if len(start) else np.zeros(0, np.int64)
            order, bucket, begin, end = _by_bucket(u, buckets)
            bits = {m["bucket"]: m["bits"] for m in batch["marks"][i].as_py() or []}
            shared = np.zeros(len(u), bool)
            for b, lo, hi in zip(bucket.tolist(), begin, end, strict=True):
                shared[order[lo:hi]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=hi - lo).view(bool)
            least, most = np.full(len(u), NONE), np.full(len(u), -NONE - 1)
            np.minimum.at(least, of, key)
            np.maximum.at(most, of, key)
            take = np.flatnonzero((shared | (least < most))[of])
            start, count, anchor, key = start[take], count[take], anchor[take], key[take]
            size = count + SIZE - 1
            rows, has = _rows_of(s.data, start, size)
            order, new = _distinct(W.hashes_of(s.data, start, start + size, W.EXACT), rows, has, key)
            group = np.cumsum(new) - 1
            first = order[new]  # the least document of each distinct run
            later = key[order] > key[first][group]
            known = order[later]
            yield _message([-1], s.segment, [_encoded(start[known], count[known])])
            own, group = order[~later], group[~later]
            n_starts = np.bincount(group, minlength=len(first))
            by, bucket, begin, end = _by_bucket(anchor[first], buckets)
            places = np.argsort(np.argsort(by)[group], kind="stable")
            own, n_starts, first = start[own][places], n_starts[by], first[by]
            upto = np.concatenate([[0], np.cumsum(n_starts)])
            yield _message(bucket, s.segment, [_run_data(rows[first[a:b]], has[first[a:b]], count[first[a:b]], key[first[a:b]], n_starts[a:b], own[upto[a] : upto[b]]) for a, b in zip(begin, end, strict=True)])


def _message(bucket: np.ndarray | list[int], segment: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([segment] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "segment", "data"])


def _run_data(rows: np.ndarray, has: np.ndarray, count: np.ndarray, key: np.ndarray, n_starts: np.ndarray, starts: np.ndarray) -> bytes:
    text = rows[has].tobytes()
    raw = b"".join((key.tobytes(), n_starts.astype(np.uint32).tobytes(), starts.astype(np.uint32).tobytes(), count.astype(np.uint8).tobytes(), text))
    return np.array([len(count), len(starts), len(raw)], np.uint32).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _run_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, size = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    raw = _ZSTD.decompress(data[12:], size, asbytes=True)
    a, b, c = 8 * n, 12 * n, 12 * n + 4 * m
    return np.frombuffer(raw[:a], np.int64), np.frombuffer(raw[a:b], np.uint32).astype(np.int64), np.frombuffer(raw[b:c], np.uint32).astype(np.int64), np.frombuffer(raw[c : c + n], np.uint8).astype(np.int64), np.frombuffer(raw[c + n :], np.uint8)


def longest_previous(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in order: the longest prefix shared with one of a smaller key.

    ``common`` has the common prefix of each suffix with the one before it (0 for the first). Each suffix looks for its
    previous (and next) smaller position by jumping over all that the position it has reached has passed already.
    """

    def scan(k: np.ndarray, c: np.ndarray) -> np.ndarray:
        at, shared = np.arange(len(k)) - 1, c.copy()
        active = np.flatnonzero(at >= 0)
        while True:
            active = active[(at[active] >= 0) & (shared[active] > 0)]
            active = active[k[at[active]] >= k[active]]
            if not len(active):
                break
            over = at[active]
            at[active], shared[active] = at[over], np.minimum(shared[active], shared[over])
        return np.where(at >= 0, shared, 0)

    if not len(keys):
        return np.zeros(0, np.int64)
    back = np.append(common[1:], 0)[::-1]  # with the one behind it, in the order from the end
    return np.maximum(scan(keys, common), scan(keys[::-1], back)[::-1])


def _later_copies(text: np.ndarray, offsets: np.ndarray, count: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first stretch and number of the stretches of distinct runs whose longest previous factor reaches SIZE."""
    of = np.repeat(np.arange(len(count)), count)
    at = np.repeat(offsets[:-1], count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(count) < 2:
        return nothing
    h = _hashed(text, SIZE)[at]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    several = order[np.append(same, False) | np.append(False, same)]  # the others share no stretch
    if not len(several):
        return nothing
    suffix = np.zeros((len(several), 56), np.uint8)
    suffix[:, :SIZE] = text[at[several][:, None] + np.arange(SIZE)]
    words = suffix.view(">u8").astype(np.uint64)
    rank = np.lexsort(words.T[::-1])
    suffix, several = suffix[rank][:, :SIZE], several[rank]
    differs = suffix[1:] != suffix[:-1]
    common = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), SIZE))
    copy = np.zeros(len(of), bool)
    copy[several] = longest_previous(keys[of[several]], common) >= SIZE
    first = np.flatnonzero(copy & ~(np.append(False, copy[:-1]) & np.append(False, of[1:] == of[:-1])))
    last = np.flatnonzero(copy & ~(np.append(copy[1:], False) & np.append(of[1:] == of[:-1], False)))
    return of[first], at[first] - offsets[of[first]], last - first + 1


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, data: stretches that are later copies."""
    freed()
    for bucket, segments, data in _buckets(batches):
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(data, pa.binary())], names=["segment", "data"])
            continue
        parts = [_run_rows(d) for d in data]
        key, n_starts, starts, count, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        segment = np.repeat(segments, [len(p[0]) for p in parts])
        del parts
        size = count + SIZE - 1
        at = np.concatenate([[0], np.cumsum(size)])
        rows, has = _rows_of(text, at[:-1], size)
        order, new = _distinct(W.hashes_of(text, at[:-1], at[1:], W.EXACT), rows, has, key)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        run, rel, n = _later_copies(rows[first][has[first]], np.concatenate([[0], np.cumsum(size[first])]), count[first], key[first])
        del rows, has
        # A run in a later document goes whole; the least document's loses the stretches found in it.
        whole = key > key[first][group]
        n_found = np.bincount(run, minlength=len(first))
        found_from = np.concatenate([[0], np.cumsum(n_found)])
        entry = np.repeat(np.arange(len(key)), n_starts)
        times = np.where(whole, 1, n_found[group])[entry]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, entry = np.repeat(starts, times), np.repeat(entry, times)
        pick = np.where(whole[entry], 0, found_from[group[entry]] + nth)
        rel, n = (np.append(x, 0) for x in (rel, n))
        start = np.where(whole[entry], start, start + rel[pick])
        length = np.where(whole[entry], count[entry], n[pick])
        to = segment[entry]
        by = np.argsort(to, kind="stable")
        ids, begin = np.unique(to[by], return_index=True)
        end = np.append(begin[1:], len(by))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([_encoded(start[by[a:b]], length[by[a:b]]) for a, b in zip(begin, end, strict=True)], pa.binary())], names=["segment", "data"])


# ---- third step: what is left ----------------------------------------------------------------------------------------

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(s: Segment, copies: list[bytes]) -> np.ndarray:
    start, count = _decoded(copies or [])
    n = len(s.data) + 1
    change = np.bincount(start, minlength=n)[:n] - np.bincount(start + count + SIZE - 1, minlength=n)[:n]
    return np.cumsum(change)[:-1] > 0


def _results(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    freed()
    for batch in batches:
        for i in range(batch.num_rows):
            s = Segment(batch, i)
            gone = _covered(s, batch["copies"][i].as_py())
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            at = s.offsets[:-1][np.diff(s.offsets) > 0]
            begins[at] = gone[at]
            n_gone, n_begun = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
            rows = []
            for k, a, b in zip(s.ids, s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
                removed = int(n_gone[b] - n_gone[a])
                kept = s.data[a:b] if not removed else s.data[a:b][~gone[a:b]]
                rows.append((k, b - a, removed, int(n_begun[b] - n_begun[a]), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield _results(rows)


def _left_of_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long documents, each document's in order."""
    freed()
    now, state = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            s = Segment(batch, i)
            if s.long_row != now:
                if state:
                    yield _results([(*state[:4], state[4].hexdigest())])
                now, state, carried, before = s.long_row, [s.ids[0], 0, 0, 0, hashlib.sha256()], np.zeros(0, bool), False
            gone = _covered(s, batch["copies"][i].as_py())
            gone[: len(carried)] |= carried
            own, carried = gone[: s.own], gone[s.own :]
            begins = own & ~np.append(before, own[:-1])
            before = bool(own[-1])
            state[1] += s.own
            state[2] += int(own.sum())
            state[3] += int(begins.sum())
            state[4].update(s.data[: s.own][~own])
    if state:
        yield _results([(*state[:4], state[4].hexdigest())])


def deduplicated(docs: DataFrame, segment_bytes: int = SEGMENT, bucket_bytes: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    segments = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(lambda b: _packed(b, segment_bytes), _SEGMENT), "repeats-segments", "uncompressed")
    buckets = max(1, (segments.agg(F.sum("size")).first()[0] or 0) // bucket_bytes)
    sent = "bucket long, segment long, data binary"
    of_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    bits = of_bucket(segments.mapInArrow(lambda b: _anchors(b, buckets, chunk), sent)).mapInArrow(_shared, "segment long, bucket long, bits binary")
    marks = bits.groupBy("segment").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    runs = segments.join(marks, "segment", "left").mapInArrow(lambda b: _candidates(b, buckets, chunk), sent)
    # What is known already needs no bucket, only to be passed on.
    runs = runs.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("segment"), F.lit(buckets))).otherwise(F.col("bucket")))
    copies = stored(of_bucket(runs).mapInArrow(_copies, "segment long, data binary"), "repeats-copies", "zstd")
    joined = segments.join(copies.groupBy("segment").agg(F.collect_list("data").alias("copies")), "segment", "left")
    short = joined.where(F.col("long_row").isNull()).mapInArrow(_left, _RESULT)
    long = joined.where(F.col("long_row").isNotNull()).repartition("long_row").sortWithinPartitions("long_row", "piece").mapInArrow(_left_of_long, _RESULT)
    out = stored(short.union(long), "repeats-result")
    dropped(segments, copies)
    return out
