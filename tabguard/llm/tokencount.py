"""Token counts of whole documents, however long, with a tokenizers-library file.

A huge document is encoded in overlapping chunks with offsets. Two neighbours are spliced at a token boundary that
both have, right after white space, where the tokens on either side agree: white space ends every pre-token of the
tokenizers this is meant for, so what stands before such a place cannot change what stands behind it. If an overlap
has no such place it is doubled until it has one or the document ends, so that a document without any white space is
held, with its tokens, as one chunk. A document that fits one chunk (``CHUNK`` bytes) needs no splicing: it is encoded
by its blank-separated pieces, each encoded once per worker and remembered; both ways give the library's counts.
That white space parts tokens is checked against the tokenizer file before anything is counted.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows with equal or null ids are kept apart; an empty
table gives an empty result; further columns are ignored. Special strings inside texts are handled as the library
does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm import pieces as P
from tabguard.llm import wordarrays as W
from tabguard.llm.shared import held

#: Characters of a chunk (bytes, for the choice of the way) and of the first overlap.
CHUNK, OVERLAP = 16384, 256
LIMIT = 2048


_checked: set[str] = set()


def check(path: str) -> None:
    """Raises if the file's pre-tokenizer could let a token hold or cross white space, or normalization could."""
    if path in _checked:
        return
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [spec.get("pre_tokenizer") or {}, *(spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    parts = [k for k in kinds if k.get("type") == "Split" and k.get("invert") and k.get("behavior") == "Removed"]
    white = "[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"
    plain = any(k.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") for k in kinds)
    import regex

    if not plain and not any(not regex.search(p["pattern"].get("Regex", " "), c) for p in parts for c in [white[1:-1]]):
        raise ValueError("this tokenizer's pre-tokens may hold white space, so chunks cannot be spliced at it")
    t = P.tokenizer(path)
    if any(a.lstrip or a.rstrip or any(map(str.isspace, a.content)) for a in t.get_added_tokens_decoder().values()):
        raise ValueError("an added token takes white space, so chunks cannot be spliced at it")
    _checked.add(path)


def _spans(enc, at: int) -> list[tuple[int, int, int]]:
    return [(a + at, b + at, i) for (a, b), i in zip(enc.offsets, enc.ids, strict=True)]


def _boundary(text: str, left: list, right: list, lo: int, hi: int) -> int | None:
    """The last stable common boundary in [lo, hi)."""
    before = {a: k for k, (a, _, _) in enumerate(left) if lo < a < hi}
    starts = {a: k for k, (a, _, _) in enumerate(right) if lo < a < hi}
    for p in sorted(before.keys() & starts.keys(), reverse=True):
        i, j = before[p], starts[p]
        same = left[i] == right[j] and (i == 0 or j == 0 or left[i - 1] == right[j - 1] or right[j - 1][0] <= lo)
        if text[p - 1].isspace() and same and (i == 0 or left[i - 1][1] <= p):
            return p
    return None


def long_tokens(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, id) of every token of ``text``, from overlapping chunks."""
    out: list[tuple[int, int, int]] = []
    start, end = 0, min(len(text), chunk)
    current = _spans(t.encode(text[start:end], add_special_tokens=False), start)
    keep_from = 0
    while end < len(text):
        width, cut = overlap, None
        while True:
            lo = max(start, end - width)
            upto = min(len(text), lo + chunk + width)
            following = _spans(t.encode(text[lo:upto], add_special_tokens=False), lo)
            cut = _boundary(text, current, following, lo, end)
            if cut is not None and cut > keep_from:
                break
            if lo <= start:  # the whole chunk overlaps: read on from its start instead
                cut = None
                break
            width *= 2
        if cut is None:
            chunk *= 2
            end = min(len(text), start + chunk)
            current = _spans(t.encode(text[start:end], add_special_tokens=False), start)
            continue
        out.extend(x for x in current if keep_from <= x[0] < cut)
        keep_from, start, end, current = cut, lo, upto, following
    out.extend(x for x in current if x[0] >= keep_from)
    return out


def _new_memory(path: str) -> tuple[P.Memory, P.Grown]:
    """A memory of pieces and the token count of each."""
    t, sizes = P.tokenizer(path), P.Grown(np.int32)
    suffix = getattr(t.model, "end_of_word_suffix", None)
    last = np.array([bool(suffix) and (t.id_to_token(i) or "").endswith(suffix) for i in range(t.get_vocab_size())])

    def learn(new: list[str]) -> None:
        n: list[int | None] = [None] * len(new)
        words = [k for k, p in enumerate(new) if p[p[0] in " \n" :].isalpha()] if suffix else []
        for i in range(0, len(words), 4096):  # one text of many words; each ends at a token that ends words
            some = words[i : i + 4096]
            ids = np.array(t.encode_batch_fast(["".join(" " + new[k] for k in some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                for k, size in zip(some, np.diff(ends, prepend=0).tolist(), strict=True):
                    n[k] = size
        rest = [k for k, size in enumerate(n) if size is None]
        for k, e in zip(rest, t.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            n[k] = len(e.ids)
        sizes.put(n)

    def forget() -> None:
        sizes.n = 0

    return P.Memory(learn, forget), sizes


def counts(path: str, column: pa.Array, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Token counts of a text column."""
    memory, sizes = held((P.Memory, path), lambda: _new_memory(path))
    data, offsets = W.bytes_of(column)
    apart = P.stops_apart(P.tokenizer(path))
    out = np.zeros(len(column), np.int64)
    for a, b in W.pieces(offsets):
        memory.room()
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        long = np.flatnonzero(np.diff(at) > chunk)
        cut = (own == 32) | (own == 10)
        starts, ends, rows = P.split(at, cut | P.before_stop(own) if apart else cut)
        of_row = np.repeat(np.arange(b - a), np.diff(rows))
        if len(long):
            short = ~np.isin(of_row, long)
            starts, ends, of_row = starts[short], ends[short], of_row[short]
        numbers = memory.numbers(own, starts, ends)
        n = sizes.all[numbers]
        out[a:b] = np.bincount(of_row, n, b - a)
        for i in long.tolist():
            out[a + i] = len(long_tokens(P.tokenizer(path), column[a + i].as_py(), chunk, overlap))
    return out


def _counted(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    check(path)
    for batch in batches:
        n = counts(path, batch.column(batch.num_columns - 1), chunk, overlap)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


def counted(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return source.mapInArrow(lambda b: _counted(b, path, chunk, overlap), schema).withColumn("over_limit", F.col("n_tokens") > limit)
