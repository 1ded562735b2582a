"""Token ids in binary files of patched frame-of-reference blocks.

A file is a row of segments, each for whole documents: a header, the document table, and blocks of 128 ids. A block
stores its minimum, a bit width that holds ``PERCENT`` % of its differences from the minimum, the packed low bits,
and an exception list (place and full difference) of the others. An index gives where each block's words and
exceptions start, so that a block can be read alone. Documents are ordered by id across files: the corpus is range
partitioned, each partition writes files of about ``ROLL`` bytes, and a manifest lists them. Readers walk the files'
segment headers first, add up what these say, and then read each segment by itself.

Defined results: null text counts as empty, so only the end id is written; rows with equal ids are written one after
another, ordered by a hash of the text; null ids come first; an empty table gives no files and an empty result; further
columns are ignored. Documents of any length stay whole; a segment grows to hold one.

The files are opened by path, so the shared folder must be mounted as one.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm import pieces as P
from tabguard.llm import wordarrays as W
from tabguard.llm.shared import folder, held, local_path, stored

BLOCK, PERCENT, END_ID = 128, 90, 0
#: Ids after which a segment is closed at the next document's end.
SEGMENT = 1 << 20
#: Bytes after which a file is closed at the next segment's end.
ROLL = 1 << 28
MAGIC = b"TGID"
HEADER = struct.Struct("<4sIQQQQ")  # magic, version, documents, ids, words, exceptions


# ---- blocks ----------------------------------------------------------------------------------------------------------


def _lanes(width: int):
    """Of each of the 128 values of a block: its word and its bit there."""
    for i in range(BLOCK):
        yield i, (i * width) // 64, (i * width) % 64


def pack(values: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of ``values`` (uint32); the last one is filled up with its own minimum."""
    n = len(values)
    count = -(-n // BLOCK)
    full = np.empty(count * BLOCK, np.uint32)
    full[:n] = values
    if n % BLOCK:
        full[n:] = values[(count - 1) * BLOCK :].min()
    full = full.reshape(count, BLOCK)
    low = full.min(axis=1) if count else np.zeros(0, np.uint32)
    delta = full - low[:, None]
    width = np.full(count, int(delta.max()).bit_length() if count else 0, np.uint8)
    most = BLOCK - (BLOCK * PERCENT) // 100  # values of a block that may be too wide
    open_ = np.arange(count)
    while len(open_) and width[open_[0]]:  # one bit less as long as enough values fit; fewer blocks each turn
        less = width[open_[0]] - 1
        open_ = open_[np.count_nonzero(delta[open_] >> less, axis=1) <= most]
        width[open_] = less
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    out = delta > limit[:, None]
    rows, places = np.nonzero(out)
    first_word = np.concatenate([[0], np.cumsum(width.astype(np.int64) * BLOCK // 64)])
    words = np.zeros(first_word[-1], np.uint64)
    kept = np.where(out, np.uint64(0), delta.astype(np.uint64))
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        packed = np.zeros((len(mine), 2 * w), np.uint64)
        v = np.ascontiguousarray(kept[mine].T)
        for i, at, shift in _lanes(w):
            packed[:, at] |= v[i] << np.uint64(shift)
            if shift + w > 64:
                packed[:, at + 1] |= v[i] >> np.uint64(64 - shift)
        words[first_word[mine][:, None] + np.arange(2 * w)] = packed
    return {
        "low": low.astype("<u4"),
        "width": width,
        "first_word": first_word[:-1].astype("<u8"),
        "first_exception": (np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))])[:-1]).astype("<u8"),
        "words": words.astype("<u8"),
        "place": places.astype(np.uint8),
        "exception": delta[rows, places].astype("<u4"),
    }


def unpack(b: dict[str, np.ndarray], n: int) -> np.ndarray:
    count = len(b["low"])
    out = np.zeros((count, BLOCK), np.uint64)
    first, words = b["first_word"].astype(np.int64), b["words"]
    for w in np.unique(b["width"][b["width"] > 0]).tolist():
        mine = np.flatnonzero(b["width"] == w)
        packed = words[first[mine][:, None] + np.arange(2 * w)].T
        mask = np.uint64((1 << w) - 1)
        v = np.empty((BLOCK, len(mine)), np.uint64)
        for i, at, shift in _lanes(w):
            x = packed[at] >> np.uint64(shift)
            if shift + w > 64:
                x = x | (packed[at + 1] << np.uint64(64 - shift))
            v[i] = x & mask
        out[mine] = v.T
    if len(b["place"]):
        ends = np.append(b["first_exception"].astype(np.int64)[1:], len(b["place"]))
        rows = np.repeat(np.arange(count), ends - b["first_exception"].astype(np.int64))
        out[rows, b["place"]] = b["exception"]
    out += b["low"].astype(np.uint64)[:, None]
    return out.reshape(-1)[:n].astype("<u4")


# ---- segments --------------------------------------------------------------------------------------------------------

_PARTS = (("low", "<u4"), ("width", "u1"), ("first_word", "<u8"), ("first_exception", "<u8"), ("words", "<u8"), ("place", "u1"), ("exception", "<u4"))


def segment(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    """One segment: ``values`` are the ids of all documents, ``lengths`` how many each one has."""
    b = pack(values)
    head = HEADER.pack(MAGIC, 1, len(doc_ids), len(values), len(b["words"]), len(b["place"]))
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.asarray(lengths, "<i8").tobytes()
    return head + table + b"".join(b[k].tobytes() for k, _ in _PARTS)


def segment_size(n_docs: int, n: int, n_words: int, n_exceptions: int) -> int:
    """Bytes of a segment, from its header."""
    return HEADER.size + 17 * n_docs + 21 * -(-n // BLOCK) + 8 * n_words + 5 * n_exceptions


def segments(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of each segment of a file."""
    at = 0
    while at < len(data):
        magic, version, n_docs, n, n_words, n_exceptions = HEADER.unpack_from(data, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of token ids")
        at += HEADER.size

        def take(kind: str, many: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, many, at)
            at += x.nbytes
            return x

        doc_ids, has, lengths = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        blocks = -(-n // BLOCK)
        sizes = {"words": n_words, "place": n_exceptions, "exception": n_exceptions}
        b = {k: take(kind, sizes.get(k, blocks)) for k, kind in _PARTS}
        yield [i if h else None for i, h in zip(doc_ids.tolist(), has.tolist(), strict=True)], lengths, unpack(b, n)


# ---- encoding, writing and reading as Spark jobs -----------------------------------------------------------------------

class Encoder:
    """Ids of texts, as numpy arrays.

    A text is cut in front of every blank or line end that another character follows; a token starts at each such
    place, as a blank is only ever taken with the word behind it. Also between a letter and a full stop or the like. Pieces are remembered; new ones are encoded in long
    texts of pieces, each behind its blank or line end, and dealt out by the tokens' byte lengths.
    """

    def __init__(self, path: str):
        self.t = P.tokenizer(path)
        self.apart = P.stops_apart(self.t)
        self.specials = bytes({a.content.encode()[0] for a in self.t.get_added_tokens_decoder().values()})
        special = {i: len(a.content.encode()) for i, a in self.t.get_added_tokens_decoder().items()}
        # A token of a byte-level vocabulary has a character for each byte.
        self.length = np.array([special.get(i, len(self.t.id_to_token(i) or "")) for i in range(max([self.t.get_vocab_size() - 1, *special]) + 1)], np.int64)
        self.ids = P.Lists(np.uint16 if len(self.length) <= 1 << 16 else np.uint32)
        self.memory = P.Memory(self._learn, self.ids.start_anew)

    def _learn(self, new: list[str]) -> None:
        flat: list[np.ndarray | None] = [None] * len(new)
        led = [k for k, p in enumerate(new) if p[0] in " \n"]
        for i in range(0, len(led), 4096):
            some = led[i : i + 4096]
            for k, own in zip(some, self._together([new[k] for k in some]), strict=True):
                flat[k] = own
        rest = [k for k, own in enumerate(flat) if own is None]
        for k, e in zip(rest, self.t.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            flat[k] = np.array(e.ids, np.uint32)
        self.ids.put(np.fromiter(map(len, flat), np.int64, len(flat)), np.concatenate(flat))

    def _together(self, part: list[str]) -> list[np.ndarray | None]:
        """Ids of pieces that all start with a blank or line end, encoded as one text; None each if tokens cross them."""
        ids = np.array(self.t.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.length[ids])
        upto = np.cumsum(np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in part), np.int64, len(part)))
        at = np.searchsorted(ends, upto) + 1
        if len(ids) < at[-1] or (ends[at - 1] != upto).any():
            return [None] * len(part)
        return [ids[a:b] for a, b in zip([0, *at.tolist()], at.tolist(), strict=False)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's followed by ``end_id``; how many each row has)"""
        self.memory.room()
        cut = P.before_word(data, offsets, self.specials)
        starts, ends, rows = P.split(offsets, cut | P.before_stop(data) if self.apart else cut)
        ids, upto = self.ids.joined(self.memory.numbers(data, starts, ends))
        return np.insert(ids.astype("<u4"), upto[rows[1:]], end_id), np.diff(upto[rows]) + 1


def encoder(path: str) -> Encoder:
    return held((Encoder, path), lambda: Encoder(path))


class _Files:
    """The files of one partition: each appears under its name when it is complete."""

    def __init__(self, to: str):
        os.makedirs(to, exist_ok=True)
        context = TaskContext.get()
        self.to, self.part, self.attempt = to, context.partitionId(), context.taskAttemptId()
        self.nth, self.f, self.done = 0, None, []

    def put(self, data: bytes) -> None:
        if self.f is None:
            self.name = f"part-{self.part:06d}-{self.nth:06d}.ids"
            self.own = f"{self.to}/.{self.name}.{os.getpid()}.{self.attempt}"
            self.f = open(self.own, "wb")  # noqa: SIM115
        self.f.write(data)
        if self.f.tell() >= ROLL:
            self.close()

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
            os.replace(self.own, f"{self.to}/{self.name}")
            self.done.append(self.name)
            self.nth, self.f = self.nth + 1, None


def _write(batches: Iterator[pa.RecordBatch], path: str, to: str, end_id: int) -> Iterator[pa.RecordBatch]:
    files, encode = _Files(to), encoder(path)
    doc_ids: list = []
    lengths: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if doc_ids:
            files.put(segment(doc_ids, np.concatenate(lengths), np.concatenate(ids)))
        for x in (doc_ids, lengths, ids):
            x.clear()
        waiting = 0

    for batch in batches:
        data, offsets = W.bytes_of(batch.column(1))
        for a, b in W.pieces(offsets):
            own, n = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
            doc_ids += batch.column(0).slice(a, b - a).to_pylist()
            lengths.append(n)
            ids.append(own)
            waiting += len(own)
            if waiting >= SEGMENT:
                flush()
    flush()
    files.close()
    yield pa.RecordBatch.from_pydict({"name": pa.array(files.done, pa.string())})


def write(docs: DataFrame, path: str, to: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents to files below ``to``; returns their manifest, a row (name) per file."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("nth"))
    ordered = source.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth").select("doc_id", "text")
    to = local_path(to)
    os.makedirs(to, exist_ok=True)
    return stored(ordered.mapInArrow(lambda b: _write(b, path, to, end_id), "name string"), "ids-manifest")


def _headers(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """name, seq, at, size, n_ids of every segment, from the headers in the files."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, at = [], 0
            with open(f"{path}/{name}", "rb") as f:
                while head := f.read(HEADER.size):
                    magic, version, n_docs, n, n_words, n_exceptions = HEADER.unpack(head)
                    if magic != MAGIC or version != 1:
                        raise ValueError(f"not a file of token ids: {name}")
                    size = segment_size(n_docs, n, n_words, n_exceptions)
                    rows.append((len(rows), at, size, n))
                    at += size
                    f.seek(at)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=["name", "seq", "at", "size", "n_ids"])


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, at, size, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open(f"{path}/{name}", "rb") as f:
                f.seek(at)
                content = f.read(size)
            for doc_ids, lengths, ids in segments(content):
                starts = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts[:-1] + before, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts what the files before hold."""
    path = local_path(path)
    found = stored(manifest.mapInArrow(lambda b: _headers(b, path), "name string, seq long, at long, size long, n_ids long"), "ids-segments")
    of_file = found.groupBy("name").agg(F.sum("n_ids").alias("n_ids"))
    # One row per file in this window, one row per segment of a file in the next.
    of_file = of_file.select("name", F.coalesce(F.sum("n_ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_from"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("inside", inside).join(of_file, "name").select("name", "seq", "at", "size", (F.col("file_from") + F.col("inside")).alias("before"))
    dealt = placed.repartition(max(1, min(found.count(), 1 << 16)), "name", "seq").select("name", "at", "size", "before")
    return dealt.mapInArrow(lambda b: _read(b, path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids to new files in the shared folder and read them back."""
    to = folder(docs.sparkSession, "ids")
    return read(write(docs, path, to, doc_id, text), to)
