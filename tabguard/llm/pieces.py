"""Text pieces between proven boundaries, numbered by 64-bit hashes of their bytes; each worker learns a piece once.

Pieces are byte stretches found and hashed with numpy, so that known ones cost no Python step each. Hashes stand for
pieces: two of 10**7 pieces that one worker holds share a hash with a probability under 10**-5.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tabguard.llm import wordarrays as W

#: Pieces that one worker remembers before it starts anew, so that its memory stays bounded.
REMEMBERED = 2_000_000
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.a, self.n = np.empty(1024, kind), 0

    def put(self, x) -> None:
        x = np.asarray(x)
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.empty(max(len(x), self.n // 2), self.a.dtype)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.a[: self.n]


class Memory:
    """piece -> number; ``learn`` is given new pieces in the order of their numbers, ``forget`` empties what it keeps."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int = REMEMBERED):
        self.learn, self.forget, self.most = learn, forget, most
        self._start()

    def _start(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def room(self) -> None:
        """Start anew if too many pieces are held; called between batches, since numbers change."""
        if len(self.keys) > self.most:
            self._start()
            self.forget()

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = W.hashes_of(data, starts, ends, W.EXACT)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == u[known]
        slots = np.empty(len(u), np.int32)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self.learn([raw[starts[i] : ends[i]].decode("utf-8", "surrogatepass") for i in first[new].tolist()])
            slots[new] = np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)
            place = at[new]
            self.keys = np.insert(self.keys, place, u[new])
            self.slots = np.insert(self.slots, place, slots[new])
        return slots[inverse]


class Lists:
    """Number -> list of whole numbers, as one flat array."""

    def __init__(self, kind):
        self.kind = kind
        self.start_anew()

    def start_anew(self) -> None:
        self.flat, self.ends = Grown(self.kind), Grown(np.int64)
        self.ends.put([0])

    def put(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Lists of the next numbers."""
        self.ends.put(np.cumsum(sizes) + self.ends.all[-1])
        self.flat.put(flat)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all their lists one after another, offsets)"""
        ends = self.ends.all
        first = ends[numbers]
        size = ends[numbers + 1] - first
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat.all[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto


def split(offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets) of the pieces: one starts at every marked byte and at every row's first one."""
    n = len(cut)
    begin = cut.copy()
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def before_word(data: np.ndarray, offsets: np.ndarray, specials: bytes = b"") -> np.ndarray:
    """Marks blanks and line ends that a character other than white space of the same row follows.

    In patterns that take the last blank in front of a word with it and white space else by itself, as byte-level
    vocabularies use, a token starts at every such place, whatever stands before it. Added tokens split a text first, so
    places in front of a byte of ``specials``, the first ones of added tokens, are not marked.
    """
    n = len(data)
    at = np.flatnonzero((data[: max(0, n - 1)] == 32) | (data[: max(0, n - 1)] == 10))
    after = data[at + 1]
    good = ~((after == 32) | ((after >= 9) & (after <= 13)))
    if specials:
        good &= ~np.isin(after, list(specials))
    wide = np.flatnonzero((after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)))
    if len(wide):  # white space of two or three bytes
        pad = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
        p = at[wide] + 1
        two, three = (pad[p] << 8) | pad[p + 1], (pad[p] << 16) | (pad[p + 1] << 8) | pad[p + 2]
        white = (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | ((three >= 0xE28080) & (three <= 0xE2808A)) | (three == 0xE280A8) | (three == 0xE280A9) | (three == 0xE280AF) | (three == 0xE2819F) | (three == 0xE38080)
        good[wide[white]] = False
    out = np.zeros(n, bool)
    out[at[good]] = True
    last = offsets[1:] - 1
    out[last[last >= 0]] = False
    return out


#: Signs that a letter is never in one token with, where words, numbers and signs are told apart.
STOPS = b".,;:!?"
_IS_STOP = np.isin(np.arange(256), list(STOPS))
_IS_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)


def before_stop(data: np.ndarray) -> np.ndarray:
    """Marks signs of ``STOPS`` that an ASCII letter stands before."""
    out = np.zeros(len(data), bool)
    out[1:] = _IS_STOP[data[1:]] & _IS_LETTER[data[:-1]]
    return out


def stops_apart(t) -> bool:
    """Whether no added token of the tokenizer holds one of ``STOPS``, so that texts may be cut there."""
    return not any(c in a.content for a in t.get_added_tokens_decoder().values() for c in STOPS.decode())
