"""Sampled subword segmentation with a SentencePiece vocabulary, and lossless decoding.

The pieces of the vocabulary form a lattice over a text. Piece probabilities are estimated from the corpus: Spark
counts the pieces of the library's own segmentation, and every piece gets a share of the rest. Forward filtering sums
the weights of all segmentations up to each place of a chunk; backward sampling then draws pieces from the end of the
chunk to its start, each in proportion to the weight of what leads up to it. Draws are hashes of (seed, row key,
chunk, step), so a row's segmentation is the same in every run, on every partitioning.

A text is cut into chunks where no piece of the vocabulary can cross: before each blank that follows another
character, and around characters that no piece holds, which are written as their UTF-8 bytes. A word (a stretch that
starts at such a blank or a line end) is cut into chunks once per worker, and a chunk's filter is computed once per
worker; all chunks of many rows are sampled at once. Chunks of up to ``PLAIN`` characters that pieces cover are
filtered many at a time, the others one by one; both ways have the same edges with the same shares.

Decoding joins the pieces, turns byte pieces into bytes, and drops the leading blank that encoding adds: the exact
text comes back. The sign that stands for a blank inside the vocabulary is itself written as bytes where a text has it.

Defined results: null text stays null and has no pieces; empty text has no pieces; rows with equal keys and equal
texts get equal pieces, a null key counts as 0; an empty table gives an empty result; further columns are kept by
``encoded``. Texts of any length are read whole.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import pieces as P
from tabguard.llm import wordarrays as W
from tabguard.llm.shared import held

BLANK = "▁"
#: Power to which piece probabilities are raised before sampling: 0 draws all segmentations alike, large ones the best.
SHARPNESS, SEED = 1.0, 17
#: Chunks whose filters and words whose chunks one worker remembers, bytes of text sampled at once, and the longest chunk
#: that is filtered together with others.
REMEMBERED, WORDS, TOGETHER, PLAIN = 600_000, 1_200_000, 1 << 19, 64
#: Weight added to every piece's count.
LEAST = 0.1


class Vocabulary:
    """Pieces of a SentencePiece file: ids by text, byte pieces, and where texts may be cut."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.ids[p] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so not every text can be decoded")
        self.longest = max(map(len, self.ids))
        self.single = {p for p in self.ids if len(p) == 1}
        self.by_length = []  # sorted hashes and ids of the pieces of each length
        for length in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == length]
            h = np.zeros(len(own), np.uint64)
            codes = np.array([[ord(c) for c in p] for p in own], np.uint64).reshape(len(own), length)
            for k in range(length):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([self.ids[p] for p in own], np.int64)[order]))
        self.chunk = next((c for c in _CHUNKS if all(p == "\n" or c.fullmatch(p) and c.match(p).end() == len(p) for p in self.ids)), None)
        if self.chunk is None:
            raise ValueError("pieces of this vocabulary cross blanks")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else (b"" if self.library.is_control(i) or self.library.is_unknown(i) else p.replace(BLANK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.spelled = P.Lists(np.uint8)  # the bytes of each piece
        self.spelled.put(np.array([len(x) for x in self.bytes_of]), np.frombuffer(b"".join(self.bytes_of), np.uint8))
        self.size = n

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]


#: Ways to cut a text whose blanks are BLANK already, the finest first: letters with the blanks before them, other
#: characters with the blanks before them, line ends alone; or without telling letters from others. A vocabulary uses
#: the first one that cuts none of its pieces.
_NUMBERS = "\\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f"
_CHUNKS = [re.compile(f"\n|{BLANK}*[^\\W{_NUMBERS}]+|{BLANK}*(?:[^\\w{BLANK}\n]|[{_NUMBERS}])+|{BLANK}+"), re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")]
#: A blank sign of the text itself, kept apart until its bytes are written.
_OWN = ""


def chunks(text: str, cut: re.Pattern, before: str = " ") -> list[str]:
    if BLANK in text or _OWN in text:
        out: list[str] = []
        for part in re.split(f"([{BLANK}{_OWN}])", before + text):
            out += ["\x00" + part] if part in (BLANK, _OWN) and part else cut.findall(part.replace(" ", BLANK))
        return out
    return cut.findall((before + text).replace(" ", BLANK))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets) of stretches that no chunk crosses: from a row's start, a line end, or a blank behind another character."""
    blank = data == 32
    after = np.append(False, blank[:-1]) if len(data) else blank
    return P.split(offsets, (blank & ~after) | (data == 10))


class Sampler:
    """Filters of chunks as flat arrays: of each node (chunk, place) its edges, the likeliest first."""

    @classmethod
    def of(cls, path: str, log_p: np.ndarray, sharpness: float) -> Sampler:
        """The worker's sampler; tasks of one run share it."""
        return held((cls, path, zlib.crc32(log_p), sharpness), lambda: cls(Vocabulary.of(path), log_p, sharpness))

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray, sharpness: float):
        self.v, self.log_p = vocabulary, log_p * sharpness
        self.start()

    def start(self) -> None:
        self.chunks = P.Memory(self.add, lambda: None, REMEMBERED)
        self.chunks_of = P.Lists(np.int32)  # of each word
        self.words = P.Memory(self._learn, self.chunks_of.start_anew, WORDS)
        self.last = P.Grown(np.int32)  # the last node of each chunk
        self.edge_of = P.Grown(np.int32)  # the end of each node's edges
        self.share = P.Grown(np.float32)  # cumulative over a node's edges
        self.piece = P.Grown(np.uint16 if self.v.size <= 1 << 16 else np.int32)
        self.step = P.Grown(np.uint8 if self.v.longest < 256 else np.int32)  # nodes back to the piece's start

    def _learn(self, new: list[str]) -> None:
        """Chunks of new words, their filters computed where they are new too. A word at a row's start has its blank already."""
        cut = [chunks(w, self.v.chunk, "") for w in new]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        raw = [c.encode("utf-8", "surrogatepass") for own in cut for c in own]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        numbers = self.chunks.numbers(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
        self.chunks_of.put(sizes, numbers)

    def add(self, new: list[str]) -> None:
        """Filters of new chunks, whose last nodes are kept in the order given."""
        plain = np.array([len(c) <= PLAIN and self.v.single.issuperset(c) for c in new], bool)
        last = np.empty(len(new), np.int64)
        last[plain] = self._filter([c for c, p in zip(new, plain, strict=True) if p])
        for k in np.flatnonzero(~plain).tolist():
            last[k] = self._filter_one(new[k])
        self.last.put(last)

    def _filter(self, new: list[str]) -> np.ndarray:
        """Forward filtering over the lattices of many chunks at once, place by place; returns each one's last node."""
        if not new:
            return np.zeros(0, np.int64)
        v = self.v
        size = np.fromiter(map(len, new), np.int64, len(new))
        code = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(code))  # characters up to the chunk's end
        chunk = np.repeat(np.arange(len(new)), size)
        begin_node = np.arange(len(code)) + chunk  # a chunk has a node more than characters
        at = np.repeat(size, size) - left  # place within the chunk
        h = np.zeros(len(code), np.uint64)
        found = []
        for length, (keys, ids) in enumerate(v.by_length, 1):
            n = len(code) - length + 1
            if n <= 0:
                break
            h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + code[length - 1 :] + np.uint64(1)
            if not len(keys):
                continue
            some = np.flatnonzero(left[:n] >= length)
            key = h[some]
            k = np.searchsorted(keys, key)
            k[k == len(keys)] = 0
            ok = keys[k] == key
            found.append((some[ok], np.full(int(ok.sum()), length), ids[k[ok]]))
        first, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        end_node, end_at = begin_node[first] + length, at[first] + length
        # by place, node and length: the order within a node does not depend on the other chunks
        order = np.argsort((end_at * (len(code) + len(new)) + end_node) * (v.longest + 1) + length)
        first, piece, end_node, end_at = first[order], piece[order], end_node[order], end_at[order]
        start_node = begin_node[first]
        alpha = np.zeros(len(code) + len(new))
        weight = self.log_p[piece]
        new_node = np.append(True, end_node[1:] != end_node[:-1])
        heads = np.flatnonzero(new_node)
        group = np.cumsum(new_node) - 1
        cuts = np.searchsorted(end_at, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            g0, g1 = group[lo], group[hi - 1] + 1
            own = heads[g0:g1] - lo
            w = weight[lo:hi] + alpha[start_node[lo:hi]]
            top = np.maximum.reduceat(w, own)
            alpha[end_node[heads[g0:g1]]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(own, hi - lo)))), own))
            weight[lo:hi] = w
        p = np.exp(weight - alpha[end_node])
        length = end_node - start_node
        order = np.lexsort((length, -p, end_node))  # by node, the likeliest first
        p, node = p[order], end_node[order]
        many = np.bincount(node, minlength=len(alpha))
        upto = np.cumsum(many)
        rank = np.arange(len(p)) - (upto - many)[node]
        share = p.copy()
        for k in range(1, int(many.max())):  # added up node by node: the same in every batch
            at = np.flatnonzero(rank == k)
            share[at] += share[at - 1]
        nodes, edges = self.edge_of.n, self.share.n
        self.edge_of.put(upto + edges)
        self.share.put(share)
        self.piece.put(piece[order])
        self.step.put(length[order])
        return ends + np.arange(len(new)) + nodes

    def _filter_one(self, chunk: str) -> int:
        """The same for one chunk of any length, with characters that no piece holds as bytes."""
        v, log_p = self.v, self.log_p
        own = chunk.startswith("\x00") and chunk[1:] in (BLANK, _OWN)
        text = chunk[1:] if own else chunk
        nodes = self.edge_of.n
        node_at, alpha = [nodes], [0.0]
        edge_of, share, piece, step = [self.share.n], [], [], []
        for end in range(1, len(text) + 1):
            found = []
            if not own:
                for begin in range(max(0, end - v.longest), end):
                    i = v.ids.get(text[begin:end])
                    if i is not None:
                        found.append((alpha[begin] + log_p[i], i, node_at[begin]))
            if not found:  # the last character as bytes, one after the other
                weight, back = alpha[end - 1], node_at[end - 1]
                for b in text[end - 1].encode("utf-8", "surrogatepass"):
                    i = int(v.byte_ids[b])
                    weight += log_p[i]
                    share.append(1.0)
                    piece.append(i)
                    step.append(nodes + len(edge_of) - back)
                    back = nodes + len(edge_of)
                    edge_of.append(self.share.n + len(share))
                node_at.append(back)
                alpha.append(weight)
                continue
            found.sort(reverse=True)
            weights = np.exp(np.array([w for w, _, _ in found]) - found[0][0])
            share += (np.cumsum(weights) / weights.sum()).tolist()
            piece += [i for _, i, _ in found]
            step += [nodes + len(edge_of) - back for _, _, back in found]
            node_at.append(nodes + len(edge_of))
            edge_of.append(self.share.n + len(share))
            alpha.append(found[0][0] + float(np.log(weights.sum())))
        self.edge_of.put(edge_of)
        self.share.put(share)
        self.piece.put(piece)
        self.step.put(step)
        return node_at[-1]

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, log probability of the pieces) of rows of text, each given with a blank before it if not empty."""
        if len(self.chunks.keys) > REMEMBERED:
            self.start()
        self.words.room()
        n_rows = len(offsets) - 1
        starts, ends, rows = words(data, offsets)
        numbers = self.words.numbers(data, starts, ends)
        which, upto = self.chunks_of.joined(numbers)
        at_row = upto[rows]
        size = np.diff(at_row)
        edge_of, share, piece, step = self.edge_of.all, self.share.all, self.piece.all, self.step.all
        row = np.repeat(np.arange(n_rows), size)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        draw = W.mix(W.mix(np.ascontiguousarray(keys, np.int64).view(np.uint64)[row] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + nth.astype(np.uint64))
        chunk_at = np.arange(len(which))
        node = self.last.all[which].astype(np.int64)
        got_piece, got_chunk = [], []
        while len(node):  # backward sampling, one piece of every unfinished chunk a turn
            draw = W.mix(draw + np.uint64(0x9E3779B97F4A7C15))
            u = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            edge, stop = edge_of[node - 1].astype(np.int64), edge_of[node] - 1
            on = np.flatnonzero((u >= share[edge]) & (edge < stop))
            while len(on):
                edge[on] += 1
                on = on[(u[on] >= share[edge[on]]) & (edge[on] < stop[on])]
            got_piece.append(piece[edge])
            got_chunk.append(chunk_at)
            node = node - step[edge]
            go = np.flatnonzero((edge_of[node] > edge_of[np.maximum(node, 1) - 1]) & (node > 0))
            node, draw, chunk_at = node[go], draw[go], chunk_at[go]
        if not got_piece:
            return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64), np.zeros(n_rows)
        many = np.zeros(len(which), np.int64)
        for c in got_chunk:
            many[c] += 1
        at = np.cumsum(many)
        ids = np.empty(int(at[-1]), np.int64)
        for k, (p, c) in enumerate(zip(got_piece, got_chunk, strict=True)):
            ids[at[c] - 1 - k] = p
        ends = np.concatenate([[0], at])[at_row]
        of_row = np.repeat(np.arange(n_rows), np.diff(ends))
        return ids, ends, np.bincount(of_row, self.log_p[ids], n_rows)  # summed row by row: the same in any batch


def decode(path: str, ids) -> str:
    """The text of a row's pieces."""
    v = Vocabulary.of(path)
    return b"".join([v.bytes_of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


# ---- Spark -----------------------------------------------------------------------------------------------------------


def led(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, with the blank that encoding adds before every row that is not empty."""
    data, offsets = W.bytes_of(column)
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])


class _Counter:
    """A worker's memory of words and their pieces in the library's own segmentation."""

    def __init__(self, path: str):
        self.v = Vocabulary.of(path)
        self.pieces_of = P.Lists(np.uint16 if self.v.size <= 1 << 16 else np.int32)
        self.words = P.Memory(self._learn, self.pieces_of.start_anew, WORDS)

    @classmethod
    def of(cls, path: str) -> _Counter:
        return held((cls, path), lambda: cls(path))

    def _learn(self, new: list[str]) -> None:
        """No piece crosses a word's ends, so words are encoded alone; odd ones chunk by chunk."""
        odd = {k: chunks(w, self.v.chunk, "") for k, w in enumerate(new) if w[0] == "\n" or BLANK in w or _OWN in w or "  " in w or w[-1] == " "}
        parts = list({c for own in odd.values() for c in own})
        plain = ["" if k in odd else w[1:] if w[0] == " " else w for k, w in enumerate(new)]
        own = self.v.library.encode([*plain, *[c.replace(BLANK, " ").removeprefix(" ") for c in parts]], num_threads=1)
        of = {c: self._of_chunk(c, ids) for c, ids in zip(parts, own[len(new) :], strict=True)}
        for k, cut in odd.items():
            own[k] = [i for c in cut for i in of[c]]
        n = np.fromiter(map(len, own[: len(new)]), np.int64, len(new))
        self.pieces_of.put(n, np.fromiter(itertools.chain.from_iterable(own[: len(new)]), np.int64, int(n.sum())))

    def _of_chunk(self, chunk: str, ids: list[int]) -> list[int]:
        if chunk[0] == "\x00" and chunk[1:] in (BLANK, _OWN):
            return [int(self.v.byte_ids[b]) for b in chunk[1:].encode()]
        return [self.v.ids[chunk]] if chunk in self.v.ids else ids

    def counts(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(self.v.size, np.int64)
        data, offsets = led(column)
        for a, b in W.pieces(offsets):
            self.words.room()
            own = data[offsets[a] : offsets[b]]
            starts, ends, _ = words(own, offsets[a : b + 1] - offsets[a])
            n = np.bincount(self.words.numbers(own, starts, ends))  # each word's pieces are added up once
            some = np.flatnonzero(n)
            ids, upto = self.pieces_of.joined(some)
            total += np.bincount(ids, np.repeat(n[some], np.diff(upto)), self.v.size).astype(np.int64)
        return total


def _piece_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """How often the library's own segmentation has each piece."""
    counter = _Counter.of(path)
    total = np.zeros(counter.v.size, np.int64)
    for batch in batches:
        total += counter.counts(batch.column(0))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["piece", "n"])


def piece_log_probabilities(docs: DataFrame, path: str, text: str = "text") -> np.ndarray:
    """Log probability of every piece, from counts over all rows; as long as the vocabulary."""
    v = Vocabulary.of(path)
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lambda b: _piece_counts(b, path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row per piece
    n = np.full(v.size, LEAST)
    for r in rows:
        n[r["piece"]] += r["n"]
    return np.log(n / n.sum())


def _encoded(batches: Iterator[pa.RecordBatch], path: str, log_p: np.ndarray, sharpness: float, seed: int, digest: bool) -> Iterator[pa.RecordBatch]:
    sampler = Sampler.of(path, log_p, sharpness)
    v = sampler.v
    for batch in batches:
        keys = np.asarray(batch.column(batch.num_columns - 2).fill_null(0))
        data, offsets = led(batch.column(batch.num_columns - 1))
        for a, b in W.pieces(offsets, TOGETHER):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ids, ends, log_ps = sampler.sample(own, at, keys[a:b], seed)
            kept = [x.slice(a, b - a) for x in batch.columns[:-2]]
            if digest:
                small = ids.astype("<u4")
                back, to = v.spelled.joined(ids)
                if len(back) == len(own) and (back == own).all() and (to[ends] == at).all():
                    same = [True] * (b - a)
                else:
                    same = [back[i0:i1].tobytes() == own[j0:j1].tobytes() for i0, i1, j0, j1 in zip(to[ends], to[ends][1:], at, at[1:], strict=False)]
                crc = [zlib.crc32(small[i0:i1]) for i0, i1 in zip(ends, ends[1:], strict=False)]
                more = [pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(log_ps), pa.array(same)]
                names = ["n_pieces", "ids_crc32", "log_probability", "lossless"]
            else:
                more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(log_ps)]
                names = ["piece_ids", "log_probability"]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*batch.schema.names[:-2], *names])


def encoded(docs: DataFrame, path: str, keep: list[str], key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, seed: int = SEED, digest: bool = False, log_p: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` of every row with its sampled pieces (piece_ids, log_probability).

    With ``digest``: n_pieces, ids_crc32, log_probability and lossless (decoding gives the text back) instead.
    """
    log_p = piece_log_probabilities(docs, path, text) if log_p is None else log_p
    shared = docs.sparkSession.sparkContext.broadcast(log_p)
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    row_key = F.col(key).cast("long") if whole else F.xxhash64(F.col(key).cast("string"))
    source = docs.select(*keep, row_key.alias("_key"), F.col(text).cast("string").alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-2])
    tail = "n_pieces long, ids_crc32 long, log_probability double, lossless boolean" if digest else "piece_ids array<int>, log_probability double"
    return source.mapInArrow(lambda b: _encoded(b, path, shared.value, sharpness, seed, digest), head + tail)
