"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, without a Python loop over words.

A word's hash is a polynomial over its bytes, each replaced by a fixed random 64-bit value, modulo 2**64, then
mixed. Hashes stand for words everywhere below; two different ones among 10**9 distinct words share a hash with a
probability under 3 %, and then only merge the two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = bytes([32, 9, 10, 11, 12, 13])
#: Bytes of text handled at once, so that temporary arrays stay small.
PIECE = 1 << 21
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The value of each byte, and the same with letters A-Z as lower-case ones.
EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
VALUES = EXACT[_LOWER]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Row ranges [a, b) of about ``most`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (letters A-Z in lower case), and the n + 1 offsets of the rows in them."""
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, hashes_of(data, starts, ends), np.searchsorted(starts, offsets)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Hashes of the stretches [start, end) of ``data``, which follow one another."""
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _powers_to(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = mix((total[e] - total[s]) * inverse[s] ^ ((e - s).astype(np.uint64) << np.uint64(48)))
        i = j
    return hashes


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each word on; the last size - 1 are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + n])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)
