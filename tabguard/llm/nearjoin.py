"""N-gram Jaccard join: prefix filtering with rare n-grams first, and exact verification.

A document's set holds its distinct 5-word shingles. All shingles have one global order, by how often the corpus has
them (estimated by a count sketch of fixed size; any order is right, a good one is fast), rare ones first. Two sets
whose Jaccard similarity is 0.8 or more share a shingle in the first n - ceil(0.8 n) + 1 of either, so only documents
with a common prefix shingle are compared, and only if the length filter and the positional filter allow the needed
overlap; the positional filter counts only shingles that some other document has. The suffix filter bounds the
overlap once more from counts in sixteen hash ranges before a pair is compared in full, once.

Groups of thousands of copies are joined without all their pairs. Equal sets are one class. In every prefix shingle's
list the most central class (the one with most shingles that others have) is compared with the others; what that links
is one component. Then pairs across components are compared, in short lists one by one if they pass the filters, in
long lists block against block, so that no link between components is missed.

Sets are compared by 64-bit hashes of shingles. Results: one row per document with its component; components are
named by their least document id.

Defined results: null and wordless texts have the empty set and link with nothing; rows with equal or null ids are
kept apart as documents of their own, a component's name leaves null ids out; an empty table gives an empty result;
further columns are ignored by ``joined`` and kept by ``deduplicated``. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.components import components
from tabguard.llm.shared import dropped, freed, lean, stored
from tabguard.llm.sketch import Bits, bits_of, counts, slots

SHINGLE = 5
IS_WORD = W.byte_table(W.SPACE)
#: Slots of the frequency sketch, as a power of two.
SKETCH_BITS = 21
#: Members of an anchor that one task compares at once, and rows of a shingle's list that one join key gets.
TOGETHER, HOT = 64, 512
#: Classes that a task remembers so as not to emit them twice; later steps drop what is emitted again.
MET = 1 << 20
#: Lists with more members than this are compared by blocks of about BLOCK members.
LONG_LIST, BLOCK = 48, 512
#: Bytes of text whose sets are made at once.
PIECE = 1 << 19


# ---- sets ------------------------------------------------------------------------------------------------------------


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets): each row's distinct shingle hashes in order, for stretches of rows."""
    freed()
    lean()
    data, at = W.bytes_of(column)
    for a, b in W.pieces(at, PIECE):
        _, _, h, rows = W.words(data[at[a] : at[b]], at[a : b + 1] - at[a], IS_WORD)
        size = np.diff(rows)
        row_of = np.repeat(np.arange(b - a), np.maximum(0, size - SHINGLE + 1))
        first = np.arange(len(row_of)) - np.repeat(np.cumsum(np.maximum(0, size - SHINGLE + 1)) - np.maximum(0, size - SHINGLE + 1), np.maximum(0, size - SHINGLE + 1))
        s = W.windows(h, SHINGLE)[rows[:-1][row_of] + first] if len(row_of) else np.zeros(0, np.uint64)
        for k in range(1, SHINGLE):
            short = np.flatnonzero(size == k)
            if len(short):
                s = np.append(s, W.mix(W.windows(h, k)[rows[:-1][short]] + np.uint64(k)))
                row_of = np.append(row_of, short)
        order = np.lexsort((s, row_of))
        s, row_of = s[order], row_of[order]
        new = np.append(True, (s[1:] != s[:-1]) | (row_of[1:] != row_of[:-1])) if len(s) else np.zeros(0, bool)
        s, row_of = s[new], row_of[new]
        yield a, b, s, np.searchsorted(row_of, np.arange(b - a + 1))


def _digests(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(s ^ np.uint64(0x5BD1E995)))])
    n = np.diff(offsets).astype(np.uint64)
    return W.signed(W.mix(total[offsets[1:]] - total[offsets[:-1]] + n))


def _needed(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n)"""
    return (4 * n + 4) // 5


def _cards(batches: Iterator[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns before the text, set size, set digest, and the prefix in the global order."""
    for batch in batches:
        n_all, d_all, p_all, p_len = [], [], [], []
        for _, _, s, offsets in _sets(batch.column(batch.num_columns - 1)):
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((s, levels[slots(s, SKETCH_BITS)], row))
            length = np.where(n > 0, n - _needed(n) + 1, 0)
            place = np.arange(len(s)) - offsets[row]
            p_all.append(W.signed(s[order])[place < length[row]])
            p_len.append(length)
            n_all.append(n)
            d_all.append(_digests(s, offsets))
        join = lambda x, t=np.int64: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        ends = np.concatenate([[0], np.cumsum(join(p_len))])
        prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(join(p_all), pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(join(n_all)), pa.array(join(d_all)), prefix], names=[*batch.schema.names[:-1], "n", "digest", "prefix"])


def _shared_postings(batches: Iterator[pa.RecordBatch], seen: Bits, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, spread, digest, n, pos) of the prefix shingles whose slot says that others may have them, each class about once per task."""
    met: set[int] = set()
    for batch in batches:
        if len(met) > MET:
            met.clear()
        new = [i for i, d in enumerate(batch.column(0).to_pylist()) if d not in met and not met.add(d)]
        batch = batch.take(pa.array(new, pa.int64()))
        prefix = batch.column(2)
        length = prefix.value_lengths().to_numpy(zero_copy_only=False)
        h = prefix.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(length)), length)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
        h = np.ascontiguousarray(h)
        keep = seen.has(h)
        digest, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(spread[slots(h[keep], SKETCH_BITS)], pa.int32()), pa.array(digest[row[keep]]), pa.array(n[row[keep]]), pa.array(pos[keep])], names=["h", "spread", "digest", "n", "pos"])


def _texts(batches: Iterator[pa.RecordBatch], wanted: Bits) -> Iterator[pa.RecordBatch]:
    """(digest, text) of the documents whose class may be wanted, each class about once per task."""
    met: set[int] = set()
    for batch in batches:
        if len(met) > MET:
            met.clear()
        column = batch.column(0)
        for a, b, s, offsets in _sets(column):
            d = _digests(s, offsets)
            keep = wanted.has(d) & (np.diff(offsets) > 0)
            some = [i for i in np.flatnonzero(keep).tolist() if d[i] not in met and not met.add(d[i])]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(d[some]), column.slice(a, b - a).take(pa.array(some))], names=["digest", "text"])


# ---- verification ----------------------------------------------------------------------------------------------------

_CUTS = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 |x & y| >= 80 |x | y| for sorted arrays of distinct hashes."""
    n, m = len(x), len(y)
    cx = np.diff(np.concatenate([[0], np.searchsorted(x, _CUTS), [n]]))
    cy = np.diff(np.concatenate([[0], np.searchsorted(y, _CUTS), [m]]))
    if 180 * int(np.minimum(cx, cy).sum()) < 80 * (n + m):  # the suffix filter
        return False
    at = np.searchsorted(x, y)
    at[at == n] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= 80 * (n + m - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (anchor, salt, role, digest, text) in this order, the anchor's own row first in each group."""
    group, anchor_set = None, None
    for batch in batches:
        anchor, salt, role, digest = (batch.column(i).to_pylist() for i in range(4))
        a_out, b_out = [], []
        for a, b, s, offsets in _sets(batch.column(4)):
            for i in range(a, b):
                own = s[offsets[i - a] : offsets[i - a + 1]]
                if role[i] == 0:
                    group, anchor_set = (anchor[i], salt[i]), own
                elif group == (anchor[i], salt[i]) and _linked(anchor_set, own):
                    a_out.append(anchor[i])
                    b_out.append(digest[i])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (anchor, member, m) that link. An anchor's members are dealt to about m / TOGETHER groups, each with its text."""
    salt = F.pmod(F.xxhash64("member"), F.ceil(F.col("m") / TOGETHER)).cast("int").alias("salt")
    members = pairs.select("anchor", salt, F.lit(1).alias("role"), F.col("member").alias("digest"))
    anchors = members.select("anchor", "salt").distinct().select("anchor", "salt", F.lit(0).alias("role"), F.col("anchor").alias("digest"))
    rows = members.unionByName(anchors).join(texts, "digest").select("anchor", "salt", "role", "digest", "text")
    dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "role")
    return stored(dealt.mapInArrow(_verified, "a long, b long"), "links")


# ---- long lists ------------------------------------------------------------------------------------------------------


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between components among the members of two blocks (or one): enough of them to join what belongs together."""
    digest, root, side = (table.column(c).to_numpy() for c in ("digest", "root", "side"))
    sets: list[np.ndarray] = []
    for _, _, s, offsets in _sets(table.column("text")):
        sets += [s[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    n = np.array([len(s) for s in sets])
    i_own, j_own = key[1].as_py(), key[2].as_py()
    left, right = np.flatnonzero(side == i_own), np.flatnonzero(side == j_own)
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    u, code, many = np.unique(token, return_inverse=True, return_counts=True)
    keep = many[code] > 1  # a shingle of one member adds to no overlap
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    place = np.empty(len(sets), np.int64)
    place[left], both = np.arange(len(left)), np.zeros((len(left), len(right)), np.float32)
    place_r = np.empty(len(sets), np.int64)
    place_r[right] = np.arange(len(right))
    is_left, is_right = side == i_own, side == j_own
    width = 2048
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        c, o = code[a:b] - lo, owner[a:b]
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[place[o[is_left[o]]], c[is_left[o]]] = 1
        y[place_r[o[is_right[o]]], c[is_right[o]]] = 1
        both += x @ y.T
    link = 100 * both >= 80 * (n[left][:, None] + n[right][None, :] - both)
    p, q = np.nonzero(link & (root[left][:, None] != root[right][None, :]))
    head: dict[int, int] = {}

    def find(r: int) -> int:
        while head.get(r, r) != r:
            head[r] = head.get(head[r], head[r])
            r = head[r]
        return r

    out_a, out_b = [], []
    for a, b in zip(left[p].tolist(), right[q].tolist(), strict=True):
        ra, rb = find(int(root[a])), find(int(root[b]))
        if ra != rb:
            head[ra] = rb
            out_a.append(digest[a])
            out_b.append(digest[b])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _by_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components within each centre's members, every block of about BLOCK members against every other."""
    size = members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(size, "centre").withColumn("side", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.select("centre", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "digest", "root")
    return stored(rows.join(texts, "digest").groupBy("centre", "i", "j").applyInArrow(_block_links, "a long, b long"), "block-links")


# ---- the join --------------------------------------------------------------------------------------------------------


def _may_link(x: str, y: str) -> Column:
    """Length filter and positional filter at a common shingle of the lists' rows ``x`` and ``y``."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    overlap = F.least(F.col(f"{x}.before"), F.col(f"{y}.before")) + 1 + F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) - 1
    return (100 * F.least(n, m) >= 80 * F.greatest(n, m)) & (180 * overlap >= 80 * (n + m))


def _unique_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, with one of its anchors and the largest list it was found in."""
    once = pairs.groupBy(F.least("anchor", "member").alias("x"), F.greatest("anchor", "member").alias("y")).agg(F.max("anchor").alias("anchor"), F.max("m").alias("m"))
    return once.select("anchor", F.when(F.col("anchor") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("member"), "m")


def _spread(sketch: np.ndarray) -> np.ndarray:
    """Join keys that a list's rows are dealt to, by the sketch's count above what a slot has on average."""
    return (1 + np.maximum(0.0, sketch - 2 * sketch.mean()) / HOT).clip(max=1 << 20).astype(np.int32)


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with what ``lists`` says of their shingle; a hot list's rows are dealt to ``spread`` keys, its one row copied to each."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("spread")).cast("int"))
    return dealt.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).drop("spread"), ["h", "salt"]).drop("salt")


def classes(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cards, classes): cards has the columns ``keep``, n and digest per row; classes has digest and root."""
    spark = docs.sparkSession
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    only = source.select("_text")
    sketch = counts(only, lambda batch: (s for _, _, s, _ in _sets(batch.column(0))), SKETCH_BITS)
    levels = spark.sparkContext.broadcast(np.floor(4 * np.log2(1.0 + sketch)).astype(np.uint8))
    spread = spark.sparkContext.broadcast(_spread(sketch))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    cards = stored(source.mapInArrow(lambda b: _cards(b, levels.value), head + "n long, digest long, prefix array<long>"), "cards")

    # Shingles that two or more rows have in their prefixes; a bit table of bounded size keeps most others at home.
    common = stored(cards.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "common-shingles")
    bits = spark.sparkContext.broadcast(bits_of(common, _column, common.count()))
    dropped(common)
    postings = stored(cards.select("digest", "n", "prefix").mapInArrow(lambda b: _shared_postings(b, bits.value, spread.value), "h long, spread int, digest long, n long, pos long"), "postings")
    lists = postings.groupBy("h").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.first("spread").alias("spread")).where("a <> b").select("h", "spread")
    listed = stored(_with_lists(postings, lists).dropDuplicates(["h", "digest"]), "listed-postings")
    dropped(postings)
    # before: shingles in front of this one that others have. A row goes if even all of those and all behind would not do.
    nth = listed.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "spread"))).alias("own"), F.first("n").alias("n"))
    ranked = nth.select("digest", "n", F.size("own").alias("k"), F.posexplode("own").alias("before", "p")).select("p.h", "p.spread", "digest", "n", "p.pos", F.col("before").cast("long").alias("before"), (F.col("k") + F.floor(4 * F.col("n") / 5.0 + 0.8).cast("long") - 1).alias("others_have"))
    ranked = stored(ranked.where("5 * (before + n - pos) >= 4 * n"), "ranked-postings")
    dropped(listed)

    centre = ranked.groupBy("h").agg(F.max(F.struct((F.col("others_have") / F.col("n")).alias("share"), "digest", "n", "pos", "before")).alias("y"), F.count("*").alias("m"), F.first("spread").alias("spread")).where("m > 1")
    centred = stored(_with_lists(ranked.select("h", "spread", "digest", F.struct("digest", "n", "pos", "before").alias("x")), centre).drop("digest"), "centred-postings")
    dropped(ranked)
    stars = centred.where((F.col("x.digest") != F.col("y.digest")) & _may_link("x", "y"))
    stars = stored(_unique_pairs(stars.select(F.col("y.digest").alias("anchor"), F.col("x.digest").alias("member"), "m")), "star-pairs")
    links = _verify(stars, _fetched(only, _ends(stars)))  # the texts are not stored: they come out dealt by digest, as the join needs them

    roots = components(links).select(F.col("node").alias("digest"), "root")
    # In a list of two, the centre has met the other one.
    more_than_two = centred.where("m > 2").select("h", "spread", "x.*", F.col("y.digest").alias("centre"))
    rooted = stored(more_than_two.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted-postings")
    dropped(centred)
    # A list can still hold a link between components if it has two of them.
    open_lists = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m"), F.first("spread").alias("spread")).where("a <> b").select("h", "m", "spread")
    rest = stored(_with_lists(rooted, open_lists), "open-postings")
    dropped(rooted)
    row = F.struct("digest", "n", "pos", "before", "root")
    short = rest.where(F.col("m") <= LONG_LIST)
    x, y = short.select("h", row.alias("x"), "m"), short.select("h", row.alias("y"))
    across = x.join(y, "h").where((F.col("x.digest") < F.col("y.digest")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y"))
    across = _unique_pairs(across.select(F.col("x.digest").alias("anchor"), F.col("y.digest").alias("member"), "m"))
    done = stars.select(F.least("anchor", "member").alias("p"), F.greatest("anchor", "member").alias("q"))
    fresh = across.join(done, (F.least("anchor", "member") == F.col("p")) & (F.greatest("anchor", "member") == F.col("q")), "left_anti")
    fresh = stored(fresh, "cross-pairs")
    # Long lists around one centre have almost the same members: they are united and compared block by block.
    long = stored(rest.where(F.col("m") > LONG_LIST).groupBy("centre", "digest").agg(F.first("root").alias("root"), F.first("n").alias("n")), "long-lists")
    dropped(rest, stars)
    texts = stored(_fetched(only, _ends(fresh).unionByName(long.select("digest"))), "class-texts")
    one, more = _verify(fresh, texts), _by_blocks(long, texts)
    dropped(texts, fresh, long)
    final = components(links.unionByName(one).unionByName(more)).select(F.col("node").alias("digest"), "root")
    dropped(links, one, more)
    return cards.select(*keep, "n", "digest"), final


def _column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("anchor", "member")).alias("digest"))


def _fetched(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, text) of the classes in ``digests``, and of a few others that share their slots in a bit table."""
    need = stored(digests.distinct(), "needed-classes")
    want = docs.sparkSession.sparkContext.broadcast(bits_of(need, _column, need.count()))
    dropped(need)
    return docs.mapInArrow(lambda b: _texts(b, want.value), "digest long, text string").dropDuplicates(["digest"])


def _rooted(cards: DataFrame, roots: DataFrame) -> DataFrame:
    own = cards.join(roots, "digest", "left")
    return own.withColumn("root", F.coalesce("root", "digest"))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    cards, roots = classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    least = cards.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    least = _rooted(least, roots)
    named = least.join(least.groupBy("root").agg(F.min("first").alias("name")), "root").select("digest", "name")
    out = cards.join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that link, directly or by others, to one with a lesser id; columns as they were.

    Of equal ids the first row stays. Rows without words all stay.
    """
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"_row{k}") not in docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    cards, roots = classes(numbered.select(F.col(row).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t")), ["_row", "_id"], "_t")
    words = _rooted(cards.where("n > 0"), roots)
    first = words.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_row")).alias("m")).select("m._row")
    stay = first.unionByName(cards.where("n = 0").select("_row"))
    return numbered.join(stay.withColumnRenamed("_row", row), row, "left_semi").drop(row)
