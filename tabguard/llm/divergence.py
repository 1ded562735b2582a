"""Source divergence audit by chunk factorization: how the sources of a language differ in their terms.

A document is a bag of blank-separated chunks, and few chunks are globally distinct. So chunks are counted per document;
the counts of a chunk from the whole corpus meet in its bucket, where each globally distinct chunk is cut into terms once,
and its terms are joined back to its counts. The counts of a term then meet in the term's bucket. No term crosses a blank, so
nothing is lost.

A bag holds strings with their occurrences by (language, source) and the documents that have them by language. Bags of
documents, of a task, of chunks and of terms all add up in the same way. Occurrences are sums. Documents are kept as
numbers while there are fewer than ``least`` of them, so that a document that has a term in several chunks counts once;
beyond that only the fact is kept. So a string that is everywhere takes no more room than its groups, and a bucket merges
what comes for it as it comes.

All arithmetic is on integers. Divergences of sources are summed in blocks of (terms x sources) of one language, and only
a sum per pair of sources leaves a block. Strings are told apart by two 64-bit hashes.

Defined results: null text, language and source are the empty string; a row is a document, also if its id is null or
repeated, or its text a copy; a language without kept terms has pairs of value 0 and no ``term`` rows; an empty table
gives an empty result; further columns are ignored. Texts of any length are read whole, in pieces cut at blanks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.shared import freed, lean, stored

#: Letters, and all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A kept term is in so many documents of its language.
LEAST = 10
#: Ranks of the ``term`` part.
TOP = 10
#: Bytes of text that a task splits at once and counts before it sends them on, bytes of the corpus for a bucket, entries
#: that a bucket takes in before it adds them up, cells of a block.
PIECE, FLUSH, BUCKET, TAKEN, CELLS = 1 << 20, 1 << 23, 1 << 21, 1 << 19, 1 << 17
SCALE = 1_000_000_000

_BLANK = W.byte_table(W.SPACE)
_LETTER = W.byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_OTHER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ZSTD = pa.Codec("zstd", compression_level=1)
_SENT = "bucket long, data binary"


# ---- bags ------------------------------------------------------------------------------------------------------------


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind, copy=False)


@dataclass
class Bag:
    """Strings; occurrences (item, group, n); documents (item, lang, id) while few; pairs (item, lang) that have enough.

    Items are numbers of strings, groups and languages numbers of ``names``: pairs (language, source), and languages.
    """

    text: np.ndarray
    ends: np.ndarray
    groups: list[tuple[str, str]]
    langs: list[str]
    n_item: np.ndarray
    n_group: np.ndarray
    n: np.ndarray
    id_item: np.ndarray
    id_lang: np.ndarray
    id: np.ndarray
    sure_item: np.ndarray
    sure_lang: np.ndarray

    def entries(self) -> int:
        return len(self.n) + len(self.id) + len(self.sure_item) + len(self.ends)

    def taken(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and ends of some strings."""
        starts = np.concatenate([[0], self.ends[:-1]])[order]
        size = self.ends[order] - starts
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - size), size)
        return self.text[at], ends


def _numbers(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string its number among the distinct ones (in the order of hashes), one place of each, and its hash."""
    exact, other = (W.EXACT[_LOW], _OTHER[_LOW]) if lower else (W.EXACT, _OTHER)
    h, g = W.hashes_of(text, starts, ends, exact), W.hashes_of(text, starts, ends, other)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (g[order][1:] != g[order][:-1])).any():  # one hash for two strings
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    new = np.append(True, ~same)[: len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return number, first, h[first]


def _added(bag: Bag, least: int) -> Bag:
    """``bag`` with equal occurrences added up and equal documents counted once; its strings are distinct."""
    n_langs, n_groups = max(1, len(bag.langs)), max(1, len(bag.groups))
    key = bag.n_item * n_groups + bag.n_group
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.add.reduceat(bag.n[order], at) if len(at) else bag.n[:0]
    sure = np.unique(bag.sure_item * n_langs + bag.sure_lang)
    pair = bag.id_item * n_langs + bag.id_lang
    if len(sure):
        open_ = np.flatnonzero(sure[np.minimum(np.searchsorted(sure, pair), len(sure) - 1)] != pair)
        pair, ids = pair[open_], bag.id[open_]
    else:
        ids = bag.id
    by = np.lexsort((ids, pair))
    pair, ids = pair[by], ids[by]
    once = np.append(True, (pair[1:] != pair[:-1]) | (ids[1:] != ids[:-1]))[: len(pair)]
    pair, ids = pair[once], ids[once]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    many = np.diff(np.append(first, len(pair))) >= least
    sure = np.concatenate([sure, pair[first[many]]])
    few = ~np.repeat(many, np.diff(np.append(first, len(pair))))
    pair, ids = pair[few], ids[few]
    return Bag(bag.text, bag.ends, bag.groups, bag.langs, key[at] // n_groups, key[at] % n_groups, n, pair // n_langs, pair % n_langs, ids, sure // n_langs, sure % n_langs)


def _merged(bags: list[Bag], least: int) -> Bag:
    if len(bags) == 1:
        return bags[0]
    groups = sorted({g for b in bags for g in b.groups})
    langs = sorted({x for b in bags for x in b.langs})
    to_group, to_lang = {g: i for i, g in enumerate(groups)}, {x: i for i, x in enumerate(langs)}
    text = _joined([b.text for b in bags], np.uint8)
    base = np.cumsum([0, *(len(b.text) for b in bags)])
    ends = _joined([b.ends + k for b, k in zip(bags, base, strict=False)])
    number, first, _ = _numbers(text, np.concatenate([[0], ends[:-1]])[: len(ends)], ends)
    from_ = np.cumsum([0, *(len(b.ends) for b in bags)])
    g = [np.array([to_group[x] for x in b.groups], np.int64) for b in bags]
    la = [np.array([to_lang[x] for x in b.langs], np.int64) for b in bags]
    whole = Bag(text, ends, groups, langs, *(
        number[_joined([b.n_item + k for b, k in zip(bags, from_, strict=False)])], _joined([m[b.n_group] for b, m in zip(bags, g, strict=True)]), _joined([b.n for b in bags]),
        number[_joined([b.id_item + k for b, k in zip(bags, from_, strict=False)])], _joined([m[b.id_lang] for b, m in zip(bags, la, strict=True)]), _joined([b.id for b in bags]),
        number[_joined([b.sure_item + k for b, k in zip(bags, from_, strict=False)])], _joined([m[b.sure_lang] for b, m in zip(bags, la, strict=True)]),
    ))
    whole.text, whole.ends = whole.taken(first)
    return _added(whole, least)


def _sent(bag: Bag, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bag in parts by the bucket of its strings."""
    starts = np.concatenate([[0], bag.ends[:-1]])[: len(bag.ends)]
    bucket = ((W.hashes_of(bag.text, starts, bag.ends, W.EXACT) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    text, ends = bag.taken(order)
    upto = np.concatenate([[0], ends])
    values = []
    for item, *rest in ((bag.n_item, bag.n_group, bag.n), (bag.id_item, bag.id_lang, bag.id), (bag.sure_item, bag.sure_lang)):
        at = place[item]
        by = np.argsort(at, kind="stable")
        values.append((at[by], [r[by] for r in rest]))
    about = json.dumps([bag.groups, bag.langs]).encode()
    sizes = np.diff(upto).astype(np.uint32)
    edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])[: len(order)])
    names, data = [], []
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        parts, counts = [], []
        for at, rest in values:
            lo, hi = np.searchsorted(at, (a, b))
            counts.append(hi - lo)
            parts += [(at[lo:hi] - a).astype(np.uint32).tobytes(), rest[0][lo:hi].astype(np.uint32).tobytes(), *(r[lo:hi].tobytes() for r in rest[1:])]
        raw = b"".join([about, sizes[a:b].tobytes(), *parts, text[upto[a] : upto[b]].tobytes()])
        head = np.array([len(raw), len(about), b - a, *counts], np.int64).tobytes()
        names.append(int(bucket[order[a]]))
        data.append(head + _ZSTD.compress(raw, asbytes=True))
        if len(data) == 64 or b == len(order):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])
            names, data = [], []


def _received(data: bytes) -> Bag:
    size, about, n, occurrences, ids, sure = (int(x) for x in np.frombuffer(data, np.int64, 6))
    raw = _ZSTD.decompress(data[48:], size, asbytes=True)
    at = about

    def take(kind: type, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, k, at)
        at += out.nbytes
        return out.astype(np.int64)

    groups, langs = json.loads(raw[:about])
    ends = np.cumsum(take(np.uint32, n))
    fields = [take(np.uint32, occurrences), take(np.uint32, occurrences), take(np.int64, occurrences), take(np.uint32, ids), take(np.uint32, ids), take(np.int64, ids), take(np.uint32, sure), take(np.uint32, sure)]
    return Bag(np.frombuffer(raw, np.uint8, -1, at), ends, [tuple(g) for g in groups], langs, *fields)


def _by_bucket(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Bag]:
    """The bag of each bucket, from rows sorted by bucket."""
    now, bags, held = None, [], 0
    for batch in batches:
        for b, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now:
                if bags:
                    yield _merged(bags, least)
                now, bags, held = b, [], 0
            bags.append(_received(d.as_py()))
            held += bags[-1].entries()
            if held > TAKEN + 2 * bags[0].entries():
                bags = [_merged(bags, least)]
                held = bags[0].entries()
    if bags:
        yield _merged(bags, least)


# ---- chunks ----------------------------------------------------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE bytes that end where a chunk ends."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(b, at, at + PIECE) for b in (b" ", b"\n", b"\t"))
        if end <= at:  # one chunk is longer than a piece
            end = min((i for b in (b" ", b"\n", b"\t") if (i := text.find(b, at + PIECE)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(data: np.ndarray, ends: np.ndarray, rows: np.ndarray, group_of: np.ndarray, lang_of: np.ndarray, groups: list, langs: list, least: int) -> Bag:
    """The chunks of some texts; ``rows`` are their documents' numbers."""
    starts, stops, row_of = _strings(data, ends, _BLANK)
    number, first, _ = _numbers(data, starts, stops)
    size = stops[first] - starts[first]
    upto = np.cumsum(size)
    text = data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[first] - (upto - size), size)]
    none = np.zeros(0, np.int64)
    bag = Bag(text, upto, groups, langs, number, group_of[row_of], np.ones(len(number), np.int64), number, lang_of[row_of], rows[row_of], none, none)
    return _added(bag, least)


def _strings(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` has, and the text (ending at ``ends``) that each is in."""
    at = np.zeros(len(data) + 2, bool)
    at[1:-1] = inside[data]
    starts, stops = np.flatnonzero(at[1:-1] & ~at[:-2]), np.flatnonzero(at[1:-1] & ~at[2:]) + 1
    cut = ends[:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[at[cut] & at[cut + 1]]  # a text that ends without a blank, before one that begins without
    starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
    return starts, stops, np.searchsorted(ends, starts, side="right")


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    freed()
    lean()
    row = TaskContext.get().partitionId() << 33
    bags, taken = [], 0
    texts, rows, of, size = [], [], [], 0

    def counted() -> None:
        nonlocal texts, rows, of, size, taken
        groups, langs = sorted(set(of)), sorted({g[0] for g in of})
        g, x = {k: i for i, k in enumerate(groups)}, {k: i for i, k in enumerate(langs)}
        data = np.frombuffer(b"".join(texts), np.uint8)
        bags.append(_counted(data, np.cumsum([len(t) for t in texts]), np.array(rows), np.array([g[k] for k in of]), np.array([x[k[0]] for k in of]), groups, langs, least))
        taken += size
        texts, rows, of, size = [], [], [], 0

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            row += 1
            for piece in _pieces(text.as_py()):
                texts.append(piece)
                rows.append(row)
                of.append((lang, source))
                size += len(piece)
                if size > PIECE:
                    counted()
            if taken > FLUSH:
                yield from _sent(_merged(bags, least), buckets)
                bags, taken = [], 0
    if texts:
        counted()
    if bags:
        yield from _sent(_merged(bags, least), buckets)


# ---- terms -----------------------------------------------------------------------------------------------------------


def _spread(item: np.ndarray, items: int, chunk: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted or not by ``item`` (a chunk): (entry, term) for every term of the entry's chunk."""
    count = np.bincount(chunk, minlength=items)
    begin = np.cumsum(count) - count
    times = count[item]
    entry = np.repeat(np.arange(len(item)), times)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    return entry, term[begin[item][entry] + nth]


def _cut(bag: Bag, least: int) -> Bag:
    """The bag of the terms of a bag of chunks: each chunk is cut once, and its terms get its counts."""
    starts, stops, chunk = _strings(bag.text, bag.ends, _LETTER)
    number, first, _ = _numbers(bag.text, starts, stops, lower=True)
    n, k = len(bag.ends), max(1, len(first))
    entry, term = _spread(bag.n_item, n, chunk, number)
    once = np.unique(chunk * k + number)  # for documents, a term counts once a chunk
    id_entry, id_term = _spread(bag.id_item, n, once // k, once % k)
    sure_entry, sure_term = _spread(bag.sure_item, n, once // k, once % k)
    size = stops[first] - starts[first]
    upto = np.cumsum(size)
    text = _LOW[bag.text[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[first] - (upto - size), size)]]
    return _added(Bag(text, upto, bag.groups, bag.langs, term, bag.n_group[entry], bag.n[entry], id_term, bag.id_lang[id_entry], bag.id[id_entry], sure_term, bag.sure_lang[sure_entry]), least)


def _terms(batches: Iterator[pa.RecordBatch], buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    freed()
    lean()
    for bag in _by_bucket(batches, least):
        yield from _sent(_cut(bag, least), buckets)


def _kept(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count of terms that enough documents of the language have."""
    freed()
    lean()
    for bag in _by_bucket(batches, least):
        lang_at = {x: i for i, x in enumerate(bag.langs)}
        lang_of = np.array([lang_at[g[0]] for g in bag.groups], np.int64)
        width = max(1, len(bag.langs))
        enough = np.sort(bag.sure_item * width + bag.sure_lang)
        pair = bag.n_item * width + lang_of[bag.n_group] if len(bag.groups) else bag.n_item
        keep = np.flatnonzero(np.isin(pair, enough))
        items, at = np.unique(bag.n_item[keep], return_inverse=True)
        text, ends = bag.taken(items)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(items), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))
        lang, source = (pa.array([g[i] for g in bag.groups], pa.string()).take(pa.array(bag.n_group[keep])) for i in (0, 1))
        whole = pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(at)), pa.array(bag.n[keep])], names=["lang", "source", "term", "count"])
        for a in range(0, whole.num_rows, 8192):
            yield whole.slice(a, 8192)


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, count: the occurrences of every kept term in every group that has it."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    buckets = max(1, (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // BUCKET)
    met = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    chunks = read.mapInArrow(lambda b: _chunks(b, buckets, least), _SENT)
    terms = met(chunks).mapInArrow(lambda b: _terms(b, buckets, least), _SENT)
    return stored(met(terms).mapInArrow(lambda b: _kept(b, least), "lang string, source string, term string, count long"), "divergence-kept-counts", "zstd")


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)) on exact integers."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (n + 2 * v).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# ---- sources ---------------------------------------------------------------------------------------------------------


def _pair_sums(key: tuple, t: pa.Table) -> pa.Table:
    """Sums over one block's terms for every two sources; rows without a term are the language's sources."""
    head = t.filter(pc.is_null(t["term"])).sort_by("source")
    source = pa.concat_arrays([pa.array([], pa.string()), *head["source"].chunks])
    n, v = head["n_terms"].to_numpy().astype(np.int64), head["v"].to_numpy().astype(np.int64)
    cells = t.filter(pc.is_valid(t["term"]))
    term = pa.concat_arrays([pa.array([], pa.string()), *cells["term"].chunks]).dictionary_encode()
    below = np.maximum(n + 2 * v, 1)
    scaled = np.full((len(source), len(term.dictionary)), 2, object if len(n) and int(n.max()) * SCALE >= 1 << 62 else np.int64)
    scaled[pc.index_in(cells["source"], value_set=source).to_numpy(), term.indices.to_numpy(zero_copy_only=False)] += cells["count"].to_numpy().astype(scaled.dtype)
    p = (1 + scaled * SCALE // below[:, None]).astype(np.int64)
    a, b, sums = [], [], []
    for g in range(len(source) - 1):
        f = (p[g + 1 :] - p[g]) ** 2 // (p[g + 1 :] + p[g])
        a.append(np.full(len(f), g))
        b.append(np.arange(g + 1, len(source)))
        sums.append(f.sum(axis=1))
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    one, other = source.take(pa.array(cat(a))), source.take(pa.array(cat(b)))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "source": one, "item": other, "value": pa.array(cat(sums))})


def _ranked(df: DataFrame, top: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has the divergence of a source from every other source of its language over all kept terms, part
    ``term`` the ``top`` kept terms that the source has more of than its language.
    """
    counts = term_counts(docs, least)
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("n_terms"))
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("all_count")), "divergence-lang-terms", "zstd")
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_count").alias("lang_terms")), "lang", "left").na.fill(0, ["v", "lang_terms"])
    about = stored(groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["n_terms"]).join(langs, "lang").withColumn("blocks", F.ceil(F.col("v") * F.col("s") / CELLS).cast("int")), "divergence-groups")

    with_sizes = counts.join(about, ["lang", "source"])
    head = about.select("lang", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"), "n_terms", "v")
    cells = with_sizes.select("lang", F.pmod(F.xxhash64("term"), F.greatest(F.col("blocks"), F.lit(1))).cast("int").alias("block"), "source", "term", "count", "n_terms", "v")
    sums = head.union(cells).groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    once = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1)))).select("lang", F.when(F.col("_way") == 0, F.col("source")).otherwise(F.col("item")).alias("source"), F.when(F.col("_way") == 0, F.col("item")).otherwise(F.col("source")).alias("item"), "value")
    pairs = _ranked(both).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    p, q = _p(F.col("count"), F.col("n_terms"), F.col("v")), _p(F.col("all_count"), F.col("lang_terms"), F.col("v"))
    more = with_sizes.join(terms, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    own = _ranked(more.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value")), top)
    return pairs.union(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
lang_of AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c,
  1 + ({SCALE}::HUGEINT * (coalesce(cnt.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN lang_of l ON l.lang = g.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term
  LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM own) WHERE rank <= {TOP}
"""
