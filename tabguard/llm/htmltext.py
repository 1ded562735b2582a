"""Main text of web pages: the article by its markup, and host boilerplate by a suffix array over the host's pages.

The visible tokens of every page form its stream: the article's, then those of other blocks, then those of parts that
are not main text. Streams are concatenated, and their suffixes are sorted to the depth of ``LONG`` tokens, host by
host: suffixes that share so many are neighbours, and where they come from ``PAGES`` or more distinct pages, the
tokens are boilerplate, as is every longer substring made of such runs. No task gathers a host. Each task doubles the
ranks of its own pages' suffixes (1, 2, 4, 8 tokens) and counts the distinct pages of each group of neighbours; Spark
merges the groups of all tasks by a 64-bit hash of the host and the suffix. So that suffixes that stand alone are not
shuffled, the array is sparse at first: every run of ``LONG`` tokens has one of its ``GRAM``-token grams, the one of the
least hash, as its anchor, equal runs have equal anchors, and only runs whose anchor is on enough pages are merged.
The repeated runs are kept as sorted files of hashes that workers map into memory, so that looking up where they stand
needs no join by run, whose hot keys would be the commonest footers.

A page with an ``article`` element (or else ``main``) gives that element's text, whole, whatever it shares with others:
its repeats are only reported. A page without one gives its blocks without the covered runs, so that unique runs stay.

Defined results: null html has no text; blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments never count; an element that is never closed ends with its page, but a p, li, dd,
dt, td, th or tr as HTML has it, at the next one or with its parent; rows with equal or null ids are kept apart; a null
or odd url has the empty host; an empty table gives an empty result; further columns are ignored. Pages of any length
are read whole.

The files are opened by path, so the shared folder must be mounted as one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import wordarrays as W
from tabguard.llm.keyfiles import Keys, written
from tabguard.llm.shared import dropped, stored
from tabguard.llm.sketch import bits_of

LONG, GRAM, PAGES = 8, 4, 3
#: Bits of an anchor's hash that are counted: a filter's table has fewer slots, so more would only be carried about.
ANCHOR_BITS = 40
IS_TOKEN = W.byte_table(b" ")

# Element names and the words in class, id or role that mark what is not main text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "xmp", "iframe"}
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MARKED = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "breadcrumb", "breadcrumbs", "comment", "comments", "respond", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "complementary", "contentinfo", "search"}

#: A tag whose quotes do not close ends at its first ``>``.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^A-Za-z0-9]+")
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)

# Inside an article, words that say advert of a paragraph too; pieces of a word of class, id or role (such
# as comment-list) that mark a block, alone or with one of the pieces that follow; and what undoes that (has-comments).
ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored"}
LOOSE = ADVERT | {"promo", "comment", "comments", "cookie", "cookies", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "popup", "consent"}
SHARED, WIDGETS = {"share", "social", "related"}, {"bar", "box", "button", "buttons", "icons", "links", "list", "media", "posts", "articles", "stories", "tools", "widget"}
UNDONE = {"has", "no", "not", "with", "without"}

#: Parts of text that no other whole-word mark hides, and elements whose end tag may be left out.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
OPTIONAL = {"p", "li", "dd", "dt", "td", "th", "tr"}
#: A start tag that ends an open p.
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "li", "dd", "dt"}
#: Of an element: the group of those that its start tag ends; and what they are looked for in.
_GROUP = {"p": 0, "li": 1, "dd": 2, "dt": 2, "td": 3, "th": 3, "tr": 4}
_SPECIAL = {"article", "aside", "blockquote", "body", "button", "center", "details", "dl", "fieldset", "figure", "figcaption", "footer", "form", "header", "html", "main", "menu", "nav", "object", "ol", "pre", "section", "table", "td", "th", "ul"}
_WALLS = ({"html", "table", "td", "th", "caption", "button", "object"}, _SPECIAL, _SPECIAL, {"table", "tr"}, {"table"})
_NONE = (-1,) * len(_WALLS)


def _marks(attributes: str) -> tuple[set[str], set[str]]:
    """Whole values of class, id and role, and their pieces between other characters than letters and digits."""
    whole: set[str] = set()
    parts: set[str] = set()
    for m in _MARK.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        whole.update(value.split())
        parts.update(x for x in _WORD.split(value) if x)
    return whole, parts


def _compound(value: str) -> bool:
    """Whether one word of class, id or role is a compound that marks a block inside an article."""
    pieces = [x for x in _WORD.split(value) if x]
    return len(pieces) > 1 and pieces[0] not in UNDONE and (not LOOSE.isdisjoint(pieces) or not (SHARED.isdisjoint(pieces) or WIDGETS.isdisjoint(pieces)))


class _Open:
    """The open elements that are not inline; per element, where the next start tag finds one that it ends."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: list[tuple[int, ...]] = []
        self.count: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str) -> None:
        n, last, group = len(self.names), self.at[-1] if self.at else _NONE, _GROUP.get(name, -1)
        self.names.append(name)
        self.at.append(tuple(n if g == group else -1 if name in wall else k for g, (k, wall) in enumerate(zip(last, _WALLS, strict=True))))
        self.count[name] = self.count.get(name, 0) + 1

    def before(self, name: str) -> int:
        """How many stay open when ``name`` starts."""
        n = len(self.names)
        if n:
            if name in _GROUP and (k := self.at[-1][_GROUP[name]]) >= 0:
                n = k
            if name in _ENDS_P and (k := self.at[-1][0]) >= 0:
                n = min(n, k)
        return n

    def end(self, name: str) -> int:
        """How many stay open when ``name`` ends: all, if it is not open."""
        n = len(self.names)
        if self.count.get(name):
            n -= 1
            while self.names[n] != name:
                n -= 1
        return n

    def cut(self, n: int) -> None:
        while len(self.names) > n:
            self.count[self.names.pop()] -= 1
            self.at.pop()


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """(article blocks, other visible blocks, blocks of parts that are not main text), white space evened.

    The article is what article elements hold; without any, what main elements or those of that role hold.
    """
    inside, mainly, outside, aside = [], [], [], []
    run: list[str] = []
    articles: list[int] = []  # places of the open ones among the open elements
    mains: list[int] = []
    weak = False  # the part left out is marked by a piece of a word only: an article inside it counts
    elements = _Open()
    skip, skip_depth = "", 0  # the inline element that is being left out
    skip_at = -1  # the other element that is being left out, by its place among the open ones

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            (aside if skip or skip_at >= 0 else inside if articles else mainly if mains else outside).append(text)

    def cut(left: int) -> None:
        elements.cut(left)
        for own in (articles, mains):
            while own and own[-1] >= left:
                own.pop()

    at, n = 0, len(page)
    stop = page.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    while at < n:
        m = _TAG.search(page, at, stop) if at < stop else None
        if m is None:
            run.append(html.unescape(page[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            run.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if at == stop and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that is never closed ends with its page
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            close()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            close()
            left = elements.end(name) if m[1] else elements.before(name)
            if left <= skip_at:
                # Only an element whose end tag may be left out ends with its parent or at the next one.
                if (m[1] and left == skip_at and elements.names[skip_at] == name) or elements.names[skip_at] in OPTIONAL:
                    ended = bool(m[1]) and elements.names[skip_at] == name and left == skip_at
                    cut(left)
                    skip_at = -1
                    if ended:
                        continue
            else:
                cut(left)
        if skip:
            if name == skip:
                skip_depth += -1 if m[1] else 1
                if not skip_depth:
                    close()
                    skip = ""
            elif name not in INLINE and name not in VOID and not m[1]:
                elements.push(name)
            continue
        if m[1] or name in VOID:
            continue
        whole, parts = _marks(m[3]) if m[3] and (skip_at < 0 or name == "article") else (set(), set())
        reply = name == "article" and "comment" in whole
        if name == "article" and skip_at >= 0 and weak and not reply:
            cut(skip_at)
            skip_at = -1
        if name not in INLINE and (skip_at >= 0 or not m[3].endswith("/")):
            elements.push(name)
        if skip_at >= 0 or m[3].endswith("/"):
            continue
        # Inside an article a mark is a whole word of class, id or role, which hides a heading or paragraph only if it says
        # advert, or a compound of narrower meaning, which hides neither.
        full, within = bool(whole & MARKED), bool(articles or mains)
        if not within:
            marked = bool(parts & MARKED)
        elif name in TEXT:
            marked = bool(whole & ADVERT)
        else:
            marked = full or any(map(_compound, whole))
        if name in ASIDE or reply or (marked and name not in ("html", "body", "article", "main")):
            close()
            if name in INLINE:
                skip, skip_depth = name, 1
            else:
                skip_at, weak = len(elements) - 1, not (name in ASIDE or full or within)
        elif name == "article":
            articles.append(len(elements) - 1)
        elif name not in INLINE and (name == "main" or "main" in whole and _ROLE_MAIN.search(m[3])):
            mains.append(len(elements) - 1)
    close()
    return (inside, mainly + outside, aside) if inside else (mainly, outside, aside)


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, article, own, streams = [], [], [], []
        for url, page in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            inside, outside, aside = blocks(page.as_py() or "")
            count = lambda x: sum(t.count(" ") + 1 for t in x)
            hosts.append(_host(url.as_py()))
            article.append(count(inside))
            own.append(count(outside))
            streams.append(" ".join(inside + outside + aside))
        arrays = [*batch.columns[:-1], pa.array(hosts, pa.string()), pa.array(article, pa.int32()), pa.array(own, pa.int32()), pa.array(streams, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "host", "article", "own", "stream"])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Streams:
    """Concatenated token streams of some pages of a batch: token hashes with the host in them, and the pages' offsets."""

    def __init__(self, hosts: pa.Array, data: np.ndarray, offsets: np.ndarray):
        starts, ends, _, self.rows = W.words(data, offsets, IS_TOKEN)
        known = {h: _hash(h) for h in set(hosts.to_pylist())}
        n = np.diff(self.rows)
        self.page = np.repeat(np.arange(len(n)), n)
        own = np.array([known[h] for h in hosts.to_pylist()], np.uint64)
        self.tokens = W.mix(W.hashes_of(data, starts, ends, W.EXACT) ^ own[self.page])
        self.left = self.rows[1:][self.page] - np.arange(len(self.page))  # tokens up to the page's end

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, key, anchor) of every run of LONG tokens."""
        at = np.flatnonzero(self.left >= LONG)
        grams = W.windows(self.tokens, GRAM)
        anchor = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
        for k in range(LONG - GRAM + 1):
            np.minimum(anchor, grams[at + k], out=anchor)
        return at, W.windows(self.tokens, LONG)[at], W.mix(anchor >> np.uint64(64 - ANCHOR_BITS))

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes of LONG or more tokens in their order, for each how many tokens, up to LONG, it shares with the one before).

        Ranks of suffixes by their first 1, 2, 4, 8 tokens; a suffix that ends with its page ranks before longer ones.
        """
        rank = np.unique(self.tokens, return_inverse=True)[1] + 1
        ranks, width = [rank], 1
        while width < LONG:
            after = np.zeros(len(rank), np.int64)
            some = np.flatnonzero(self.left > width)
            after[some] = rank[some + width]
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
            ranks.append(rank)
            width *= 2
        at = np.flatnonzero(self.left >= LONG)
        order = at[np.argsort(rank[at], kind="stable")]
        shared = np.zeros(len(order), np.int64)
        if len(order):
            same = np.append(False, rank[order[1:]] == rank[order[:-1]])
            shared[same] = LONG
            for k in range(len(ranks) - 2, -1, -1):  # of those that part earlier, how far they agree, by halves
                i = np.flatnonzero(~same)[1:]
                x, y = order[i] + shared[i], order[i - 1] + shared[i]
                shared[i] += np.where(ranks[k][x] == ranks[k][y], 1 << k, 0)
        return order, shared


def _pieces(batch: pa.RecordBatch, hosts: int, streams: int) -> Iterator[tuple[int, _Streams]]:
    data, offsets = W.bytes_of(batch.column(streams))
    for a, b in W.pieces(offsets):
        yield a, _Streams(batch.column(hosts).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: anchors of runs, and on how many of the pages at hand each one is."""
    for batch in batches:
        for _, s in _pieces(batch, 0, 1):
            at, _, anchor = s.runs()
            page = s.page[at]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (page[1:] != page[:-1])) if len(at) else np.zeros(0, bool)
            anchor, page = anchor[new], page[new]
            order = np.lexsort((page, anchor))
            anchor, page = anchor[order], page[order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (page[1:] != page[:-1])) if len(anchor) else np.zeros(0, bool)
            u, n = np.unique(anchor[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(u)), pa.array(n, pa.int64())], names=["key", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch], likely) -> Iterator[pa.RecordBatch]:
    """run, n: groups of neighbours in the suffix array that share LONG tokens, and on how many pages they are."""
    for batch in batches:
        for _, s in _pieces(batch, 0, 1):
            order, shared = s.suffix_array()
            at, key, anchor = s.runs()
            place = np.full(len(s.tokens), -1)
            place[at] = np.arange(len(at))
            first = np.flatnonzero(shared < LONG)
            page = s.page[order]
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            new = np.append(True, (page[1:] != page[:-1]) | (group[1:] != group[:-1])) if len(order) else np.zeros(0, bool)
            n = np.bincount(group[new], minlength=len(first))  # suffixes of a group are in page order
            own = place[order[first]]
            ok = likely.value.has(anchor[own])
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(key[own][ok])), pa.array(n[ok], pa.int64())], names=["run", "n"])


def _cut(batches: Iterator[pa.RecordBatch], likely, often: tuple[str, int]) -> Iterator[pa.RecordBatch]:
    """Text of each page, and how many tokens of its article and of its other blocks the repeated runs cover."""
    keys = Keys.of(often)
    for batch in batches:
        article, own = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
        streams = batch.column(5)
        texts, inside, outside = [], [], []
        for a, s in _pieces(batch, 2, 5):
            at, key, anchor = s.runs()
            some = np.flatnonzero(likely.value.has(anchor))
            some = some[keys.has(key[some])]
            mark = np.zeros(len(s.tokens) + 1, np.int64)
            mark[at[some]] += 1  # runs start at different places
            np.add.at(mark, at[some] + LONG, -1)
            covered = np.cumsum(mark)[:-1] > 0
            for k, (i, j) in enumerate(zip(s.rows, s.rows[1:], strict=False)):
                n, m = article[a + k], own[a + k]
                here = covered[i:j]
                inside.append(int(here[:n].sum()))
                outside.append(int(here[n : n + m].sum()))
                tokens = streams[a + k].as_py().split(" ")[: n + m]
                texts.append(" ".join(tokens[:n] if n else [tokens[x] for x in np.flatnonzero(~here[:m]).tolist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(inside, pa.int64()), pa.array(outside, pa.int64())], names=["page_id", "url", "text", "n_shared", "n_boilerplate"])


def _longs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def repeated_runs(parsed: DataFrame) -> tuple[Broadcast, tuple[str, int]]:
    """(filter of anchors, files of the runs of LONG tokens on PAGES or more pages of one host)"""
    streams = parsed.select("host", "stream")
    anchors = stored(streams.mapInArrow(_anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("key"), "html-anchors")
    likely = parsed.sparkSession.sparkContext.broadcast(bits_of(anchors, _longs, anchors.count()))
    dropped(anchors)
    groups = streams.mapInArrow(lambda b: _neighbours(b, likely), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    often = stored(groups.where(F.col("n") >= PAGES).select("run"), "html-runs")
    at = written(often, "html-run-files")
    dropped(often)
    return likely, at


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, with n_shared and n_boilerplate: repeated tokens in and outside the article."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    parsed = stored(source.mapInArrow(_parsed, f"page_id {kind}, url string, host string, article int, own int, stream string"), "html-streams", compression="zstd")
    likely, often = repeated_runs(parsed)
    out = parsed.mapInArrow(lambda b: _cut(b, likely, often), f"page_id {kind}, url string, text string, n_shared long, n_boilerplate long")
    return out.withColumn("n_chars", F.length("text").cast("long"))
