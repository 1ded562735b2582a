"""Hard negatives, later copies and source divergence against brute force, and their defined results on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabguard.llm import divergence, negatives, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECS = "vec_id long, embedding array<float>, label int"
ODD = [None, "", " ", "\n\n", "a", "word " * 40, "é" * 300 + " x\ty\r\nz", "▁ and  <|endoftext|> \x00", "A.B " * 400, "a" * 5000, "ab" * 3000]


def odd(spark):
    rows = [(i, t, "en", f"src{i % 3}", 1) for i, t in enumerate(ODD)] + [(3, ODD[9], None, None, None), (None, ODD[8], "en", "s", 1), (None, ODD[8], "en", "s", 1), (None, None, None, None, None)]
    rows += [(20 + i, "Straße, straße (STRASSE) naïve-naïve x1y Ünï code z " * 2, "de", f"s{i % 4}", 1) for i in range(14)]
    return spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("segment", F.lit(1)).withColumn("term", F.lit("t"))


# ---- hard negatives --------------------------------------------------------------------------------------------------


def mine(rows, moved=True):
    """By the words of the contract, one pair at a time."""
    at = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if moved and i % 7 == 0 else label
        at[i] = min(at.get(i, (99, ())), (label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = []
    for a, (la, va) in at.items():
        if a % 100:
            continue
        score = {b: sum(x * y for x, y in zip(va, vb)) for b, (_, vb) in at.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if at[b][0] == la][:5]:
            fit = [b for b in order if at[b][0] != la and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mined(negatives.scaled(df, label), lambda: F.col("vec_id") % 100 == 0).collect()))


def test_hard_negatives(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(r.normal(0.1, 0.2, 8), 2)], int(r.integers(3))) for i in range(900)]  # rounded: many ties
    rows += [(1000, None, 1), (None, rows[0][1], 1), (1100, [float("nan")] * 8, 1), (1200, [float("inf")] + [0.0] * 7, 0), (1300, [None] * 8, 0), (1400, [], 2), (1500, [0.5, 0.5], 2), (1600, [0.0] * 8, None)]
    rows += [(100, rows[3][1], 2), (100, rows[100][1], rows[100][2]), (101, rows[101][1], rows[101][2]), (-200, rows[5][1], 1)]
    df = spark.createDataFrame(rows, VECS).withColumn("score", F.lit(1)).withColumn("cell", F.lit(1)).repartition(3)
    got = mined(df)
    assert got == mine(rows) and len(got) > 300
    assert mined(spark.createDataFrame([], VECS)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], VECS)) == []
    with pytest.raises(Exception, match="2\\*\\*53"):
        mined(spark.createDataFrame([(100, [1e15], 1), (101, [1e15], 1)], VECS))


def test_best_of_batches():
    r = np.random.default_rng(2)
    best, every = negatives.Best(7, 4), []
    for k in range(6):
        s = r.integers(0, 5, (7, 9)).astype(float)
        s[r.random((7, 9)) < 0.3] = -np.inf
        best.add(s, np.arange(9) + 9 * (5 - k))
        every.append((s, np.arange(9) + 9 * (5 - k)))
    for i in range(7):
        want = sorted((-s, int(c)) for m, ids in every for s, c in zip(m[i], ids) if s > -np.inf)[:4]
        assert [(-s, int(c)) for s, c in zip(best.score[i], best.id[i]) if s > -np.inf] == want


# ---- later copies ----------------------------------------------------------------------------------------------------


def left(rows, size=50):
    first, last = {}, 1 << 63
    key = lambda i: last if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            first[b[s : s + size]] = min(first.get(b[s : s + size], last), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < key(i):
                gone[s : s + size] = True
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), int(gone.sum()), int(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def prose_rows(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(30) for _ in range(6)]
    rows = []
    for _ in range(100):
        t = prose(r.randint(0, 60))
        if r.random() < 0.5:
            t += " " + r.choice(passages)[r.randint(0, 40) :] + prose(r.randint(0, 20))
        if r.random() < 0.2 and rows:
            o = r.choice(rows)[1]
            t = o[: len(o) // 2] + "X" + o[len(o) // 2 :]
        rows.append((r.randint(0, 90), t))
    rows += [(None, passages[0]), (None, passages[0]), (5, None), (6, ""), (200, "a" * 5000), (201, "a" * 49), (202, "a" * 60 + "bbb"), (203, "ab" * 4000), (204, ("x" * 50 + " ") * 30), (205, prose(1500)), (206, rows[3][1] * 3)]
    return [*rows, (207, rows[-2][1][1000:9000] + "tail")]


@pytest.mark.parametrize("segment", [3000, 1 << 22])
def test_later_copies(spark, segment):
    rows = prose_rows(segment)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.deduplicated(df, segment, 2000, 700).collect()), key=repr) == left(rows)


def test_later_copies_on_odd_tables(spark):
    df = odd(spark)
    assert sorted(map(tuple, repeats.deduplicated(df).collect()), key=repr) == left([(r["doc_id"], r["text"]) for r in df.collect()])
    assert repeats.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_longest_previous_factors():
    r = random.Random(4)
    for _ in range(200):
        texts = sorted("".join(r.choice("ab") for _ in range(8)) for _ in range(r.randint(1, 30)))
        keys = [r.randint(0, 6) for _ in texts]
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 8)
        common = [0] + [share(a, b) for a, b in zip(texts, texts[1:])]
        want = [max((share(t, o) for o, q in zip(texts, keys) if q < k), default=0) for t, k in zip(texts, keys)]
        assert repeats.longest_previous(np.array(keys), np.array(common)).tolist() == want


# ---- source divergence -----------------------------------------------------------------------------------------------


def audit(rows, least=10):
    """By the words of the contract, with Python's integers."""
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(t))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, val, k) for k, (val, i) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("a", "ö", "Z", "中")] + ["x-y", "a,b", "(q)", "Q.", "q", "--", "12"]
    rows = [(" ".join(r.choice(words[: 10 + 10 * (i % 4)]) + r.choice(["", ",", ".", "!", "'s"]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), f"s{i % 5}") for i in range(200)]
    rows += [("rare, " + ("rare" if i % 2 else "rare."), "en", f"s{i % 3}") for i in range(9)] + [(f"edge{',' * (i % 4)} edge", "de", f"s{i % 3}") for i in range(10)]
    return rows


def test_source_divergence(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(rows)], DOCS).repartition(4)
    want = audit(rows)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    monkeypatch.setattr(divergence, "CELLS", 16)  # many blocks
    monkeypatch.setattr(divergence, "BUCKET", 100)  # and buckets
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.AUDIT_SQL})").fetchall()) == want


def test_source_divergence_on_odd_tables(spark):
    df = odd(spark)
    got = sorted(map(tuple, divergence.audit(df).collect()))
    assert got == audit([(r["text"], r["lang"], r["source"]) for r in df.collect()])
    assert any(x[2] == "term" for x in got) and divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_bags_add_up_however_they_are_taken_in(monkeypatch):
    rows = corpus(5)
    groups = sorted({(x or "", s) for _, x, s in rows})
    langs = sorted({g[0] for g in groups})

    def bag(part):
        data = [t.encode() for _, (t, _, _) in part]
        of = np.array([groups.index((x or "", s)) for _, (_, x, s) in part])
        return divergence._counted(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), np.array([i for i, _ in part]), of, np.array([langs.index(groups[g][0]) for g in of]), groups, langs, 4)

    def content(b):
        text, starts = b.text.tobytes(), [0, *b.ends]
        word = [text[x:y] for x, y in zip(starts, b.ends)]
        sure = {(word[i], b.langs[k]) for i, k in zip(b.sure_item, b.sure_lang)}
        return {(word[i], b.groups[g], int(n)) for i, g, n in zip(b.n_item, b.n_group, b.n)}, sure, {(word[i], b.langs[k], int(d)) for i, k, d in zip(b.id_item, b.id_lang, b.id)}

    numbered = list(enumerate(rows))
    whole = bag(numbered)
    parts = [bag(numbered[a : a + 17]) for a in range(0, len(numbered), 17)]
    assert content(divergence._merged(parts, 4)) == content(whole)
    sent = [x for p in parts for b in divergence._sent(p, 7) for x in zip(b["bucket"].to_pylist(), b["data"].to_pylist())]
    monkeypatch.setattr(divergence, "TAKEN", 20)
    batch = pa.RecordBatch.from_pydict({"bucket": [k for k, _ in sorted(sent)], "data": [d for _, d in sorted(sent)]})
    got = [content(b) for b in divergence._by_bucket(iter([batch.slice(0, 5), batch.slice(5)]), 4)]
    assert len(got) == 7 and tuple(set().union(*x) for x in zip(*got)) == content(whole)
    words = Counter((w, g) for _, (t, x, s) in numbered for g in [(x or "", s)] for w in t.encode().split())
    assert content(whole)[0] == {(w, g, n) for (w, g), n in words.items()}


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    r = random.Random(3)
    text = "".join(r.choice(["ab", "c", " ", "\n", "\t", "\r", "d" * 30]) for _ in range(400)).encode()
    assert [w for p in divergence._pieces(text) for w in p.split()] == text.split()
