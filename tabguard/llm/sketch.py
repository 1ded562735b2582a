"""Fixed-size tables of counts or bits over 64-bit hashes, gathered from a column of hash arrays."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slots of one piece in which partial tables travel.
_SLICE = 1 << 16


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch], hashes: Callable, bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << bits, np.uint64)
    for batch in batches:
        for h in hashes(batch):
            u, n = np.unique(slots(h, bits), return_counts=True)
            table[u] += n.astype(np.uint64)
    parts = table.reshape(-1, min(_SLICE, len(table)))
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some.tolist()], pa.binary())], names=["slice", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(c.as_buffer()), np.uint64)
            total[k] = total[k] + part if k in total else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "counts"])


def counts(df: DataFrame, hashes: Callable, bits: int) -> np.ndarray:
    """How many hashes fall into each of 2**bits slots, over all rows.

    ``hashes`` yields the hash arrays of a batch. The table's size does not grow with the data; partial tables are
    summed by slices across the cluster before the one result comes to the driver.
    """
    spark = df.sparkSession
    parts = df.mapInArrow(lambda b: _partial(b, hashes, bits), "slice int, counts binary")
    n = max(1, min((1 << bits) // _SLICE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    summed = parts.repartitionById(n, parts["slice"] % n).mapInArrow(_summed, "slice int, counts binary")
    out = np.zeros((max(1, (1 << bits) // _SLICE), min(_SLICE, 1 << bits)), np.uint64)
    for r in summed.toLocalIterator():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.reshape(-1)


def _partial_bits(batches: Iterator[pa.RecordBatch], hashes: Callable, bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << bits, bool)
    for batch in batches:
        for h in hashes(batch):
            table[slots(h, bits)] = True
    parts = table.reshape(-1, min(16 * _SLICE, len(table)))
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(np.packbits(parts[i]).tobytes(), 1) for i in some.tolist()], pa.binary())], names=["slice", "set"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(c.as_buffer()), np.uint8)
            total[k] = total[k] | part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "set"])


class Bits:
    """Which of 2**bits slots are taken, as packed bits: no false no, some false yes."""

    #: The largest table, 16 MB packed.
    MOST = 27

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        at = slots(h, self.bits)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def bits_of(df: DataFrame, hashes: Callable, n: int) -> Bits:
    """Slots of the hashes in ``df``; n: how many distinct ones there are.

    The table has at least sixteen slots a hash until it reaches its largest size; from there on more and more hashes
    pass that are not in ``df``. Callers join exactly behind it, so only their work changes with that, bit by bit.
    """
    bits = min(max(16, int(n).bit_length() + 4), Bits.MOST)
    spark = df.sparkSession
    per = min(16 * _SLICE, 1 << bits)
    parts = df.mapInArrow(lambda b: _partial_bits(b, hashes, bits), "slice int, set binary")
    k = max(1, min((1 << bits) // per, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros(((1 << bits) // per, per // 8), np.uint8)
    for r in parts.repartitionById(k, parts["slice"] % k).mapInArrow(_united, "slice int, set binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["set"]), np.uint8)
    return Bits(bits, out.reshape(-1))
