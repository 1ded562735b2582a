"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

A pattern is a benchmark window of 13 consecutive words (an item with fewer words is one pattern of its own length).
For each pattern length, a shift table over blocks of two words tells how far a search position can move on without
missing a pattern; where the shift is zero, the hash of the window's suffix selects a bucket of patterns, and direct
comparison of all words confirms. Many positions advance at once: every stretch of text has its own cursor.

Words are compared as 64-bit hashes (see wordarrays). Pairs of a pattern and an item are dealt to blocks of about
``most_patterns``; the driver holds and broadcasts one block at a time. Where there are several, each block's hits are
written to the shared folder before the next one is taken, and merged at the end. Workers build a block's tables once.

Defined results: null or wordless text has no words and is not contaminated; an item without words never occurs;
rows with equal or null ids are kept apart; items with equal ids count once; null item ids count as the empty
string; an empty table gives an empty result and an empty benchmark contaminates nothing; further columns pass
through ``cleaned``. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.shared import held, stored

WINDOW = 13
#: Pairs of pattern and item in one broadcast block: 13 hashes of 8 bytes each, so about 30 MB.
MOST_PATTERNS = 1 << 18
#: Least and largest slots of a shift table, as powers of two; between them it has sixteen slots for a block of words.
SHIFT_BITS = (14, 24)
#: Words that one cursor passes over.
STRETCH = 512
IS_WORD = W.byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
IS_WORD[65:91] = True  # letters A-Z are lowered before the words are taken


class Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, words: np.ndarray):
        self.words = words  # one row per pattern
        self.size = words.shape[1]
        self.block = min(2, self.size)
        self.bits = min(max(SHIFT_BITS[0], int(words.size).bit_length() + 4), SHIFT_BITS[1])
        self.shift = np.full(1 << self.bits, self.size - self.block + 1, np.int32)
        for end in range(self.block, self.size + 1):  # later blocks are nearer to the end: smaller shifts
            np.minimum.at(self.shift, self.slots(words[:, end - self.block : end]), self.size - end)
        keys = self.suffix(words)
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = order, keys[order]

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        h = blocks[..., 0] if blocks.shape[-1] == 1 else blocks[..., 0] * np.uint64(0x9E3779B97F4A7C15) + blocks[..., 1]
        return (W.mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def suffix(windows: np.ndarray) -> np.ndarray:
        """Hash of each row's last four words."""
        h = np.zeros(len(windows), np.uint64)
        for k in range(max(0, windows.shape[1] - 4), windows.shape[1]):
            h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + windows[:, k])
        return h

    def find(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in the word hashes ``h``; rows: offsets of the documents."""
        m = self.size
        counts = np.diff(rows)
        parts = np.maximum(0, -(-(counts - m + 1) // STRETCH))
        doc = np.repeat(np.arange(len(counts)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = rows[:-1][doc] + nth * STRETCH + m - 1  # the last word of each cursor's window
        stop = np.minimum(at + STRETCH, rows[1:][doc])
        firsts, found = [], []
        while len(at):
            blocks = np.stack([h[at - self.block + 1 + k] for k in range(self.block)], axis=-1)
            jump = self.shift[self.slots(blocks)]
            here = at[jump == 0]
            if len(here):
                windows = h[here[:, None] + np.arange(1 - m, 1)]
                keys = self.suffix(windows)
                lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
                some = np.flatnonzero(hi > lo)
                n = (hi - lo)[some]
                which = np.repeat(some, n)
                pattern = self.order[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                same = (self.words[pattern] == windows[which]).all(axis=1)
                firsts.append(here[which[same]] - m + 1)
                found.append(pattern[same])
            at = at + np.maximum(1, jump)
            go = at < stop
            at, stop = at[go], stop[go]
        none = np.zeros(0, np.int64)
        return (np.concatenate(firsts), np.concatenate(found)) if firsts else (none, none)


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.bytes_of(batch.column(1))
        _, _, h, rows = W.words(data, offsets, IS_WORD)
        ids, out = [], []
        for item, a, b in zip(batch.column(0).to_pylist(), rows, rows[1:], strict=False):
            m = min(window, b - a)
            for i in range(a, b - m + 1 if m else a):
                ids.append(item)
                out.append(W.signed(h[i : i + m]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "words"])


def patterns(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct pairs (words, item_id): the hashes of a pattern, and an item that has it."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("string").alias("text"))
    return items.mapInArrow(lambda b: _item_windows(b, window), "item_id string, words array<long>").distinct()


def _search(batches: Iterator[pa.RecordBatch], searches: list, items: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """Per row: the columns before the text, n_words, hit intervals [from, to) in words, and items that occur."""
    for batch in batches:
        data, offsets = W.bytes_of(batch.column(batch.num_columns - 1))
        n_words, hits, which = [], [], []
        for a, b in W.pieces(offsets):
            _, _, h, rows = W.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], IS_WORD)
            n_words.append(np.diff(rows))
            own: dict[int, list[tuple[int, int, int]]] = {}
            for numbers, search in searches:
                first, pattern = search.find(h, rows)
                doc = np.searchsorted(rows, first, side="right") - 1
                for d, f, p in zip(doc.tolist(), (first - rows[doc]).tolist(), pattern.tolist(), strict=False):
                    own.setdefault(d, []).append((f, f + search.size, numbers[p]))
            for d in range(b - a):
                merged: list[list[int]] = []
                for f, t, _ in sorted(own.get(d, ())):
                    if merged and f <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], t)
                    else:
                        merged.append([f, t])
                hits.append([x for pair in merged for x in pair])
                which.append(sorted({i for _, _, p in own.get(d, ()) for i in items[p]}))
        counted = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        arrays = [*batch.columns[:-1], pa.array(counted, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(which, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_words", "hits", "items"])


def _ready(block: pa.Table):
    words, items = block.column("words").combine_chunks(), block.column("items").to_pylist()
    sizes = np.asarray(words.value_lengths().fill_null(0)) if len(words) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.asarray(words.flatten()).astype(np.int64).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
    searches = []
    for m in np.unique(sizes):
        numbers = np.flatnonzero(sizes == m)
        searches.append((numbers, Patterns(flat[starts[numbers][:, None] + np.arange(m)])))
    return searches, items


#: The tables of the block that the worker searches for.
def _tables_of(name: str, block: pa.Table) -> tuple:
    return held(("patterns", name), lambda: _ready(block))


def occurrences(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_words, n_hit (words inside any occurrence) and items."""
    spark = docs.sparkSession
    pairs = stored(patterns(benchmark, item_id, item_text, window), "patterns")
    parts = max(1, -(-pairs.count() // most_patterns))

    def searched(source: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
        own = pairs.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(parts)) == k)
        shared = spark.sparkContext.broadcast(own.groupBy("words").agg(F.sort_array(F.collect_list("item_id")).alias("items")).toArrow())
        name = uuid.uuid4().hex
        head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
        schema = (head + ", " if head else "") + "n_words long, hits array<long>, items array<string>"
        return source.mapInArrow(lambda b: _search(b, *_tables_of(name, shared.value)), schema), shared

    if parts == 1:
        out, _ = searched(docs.select(*keep, F.col(text).cast("string").alias("_text")), 0)
    else:
        rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"in_{c}") for c in keep], F.col(text).cast("string").alias("_text")), "decontaminate-rows")
        hits = None
        for k in range(parts):
            found, shared = searched(rows.select("_row", "_text"), k)
            own = stored(found.where((F.size("hits") > 0) | (F.lit(k == 0))), f"pattern-hits-{k}")
            shared.destroy()
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = rows.drop("_text").join(hits, "_row").select(*[F.col(f"in_{c}").alias(c) for c in keep], "n_words", "hits", "items")
    pair = F.transform(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1), lambda i: F.struct(F.get("hits", (2 * i).cast("int")).alias("a"), F.get("hits", (2 * i + 1).cast("int")).alias("b")))
    total = F.aggregate(
        F.sort_array(F.when(F.size("hits") > 0, pair).otherwise(F.array().cast("array<struct<a:long,b:long>>"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], acc["upto"]))).cast("long").alias("n"), F.greatest(p["b"], acc["upto"]).alias("upto")),
    )["n"]
    return out.select(*keep, "n_words", total.alias("n_hit"), "items")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256, contaminated."""
    out = occurrences(docs, benchmark, [doc_id], text)
    return out.select(doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they were."""
    names = docs.columns
    boxed = docs.select(F.struct(*names).alias("_box"), F.col(text).alias("_read"))
    out = occurrences(boxed, benchmark, ["_box"], "_read")
    return out.where(~F.expr(CONTAMINATED)).select("_box.*")
