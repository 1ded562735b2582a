"""Personal data by pattern, widened by bootstrapped contextual extraction.

Seeds are the entities that the base patterns find. The words around them are lexical patterns of three forms: the
word before, the two words before, and the word before with the word behind. A word is a run of letters and digits that
may hold ``_``, ``-`` and apostrophes inside; signs and quotes between it and the match do not matter. Pattern-instance
edges are scored in turns: a pattern's score is the share of its occurrences that precede believed instances, an
instance's score the chance that one of its patterns is right, until no score changes. A pattern scores from the turn on
in which enough distinct instances of it are believed, seeds or not, so what one turn reveals induces the patterns of
the next. All occurrences of a single word
in the corpus count; of the longer forms, those at matches of any kind. Patterns of high confidence with enough
distinct instances then reveal identifiers that no base pattern matches; they become spans of kind ``id``. Only built-in
functions run on the rows.

Words are looked for among the ``NEAR`` blank-separated strings next to a match. Belief only grows from turn to turn,
so the turns end.

Defined results: null text counts as empty; rows with equal or null ids are kept apart, one result each; an empty
table gives an empty result; further columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import dropped, stored
from tabguard.llm.spans import found, joined, placed

# The base patterns, in the order in which the kinds are listed. Possessive quantifiers and the guards
# before the first character keep them linear on long runs; they match what the plain patterns match.
KINDS = ["email", "ip", "card", "phone", "id"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{5,}+",
}
#: Blank-separated strings next to a match in which its context words are looked for.
NEAR = 6
#: What parts words.
APART = r"[^\p{L}\p{N}_'\u2019-]++"
#: Least score of a believed pattern or instance, and least number of distinct believed instances of a pattern.
CONFIDENT, SEEDS = 0.6, 3
#: Relative change of all scores together below which the turns end.
SETTLED = 1e-6


def _valid(value: Column, kind: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    nums = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    luhn = F.aggregate(nums, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0
    card = F.length(digits).between(16, 19) & luhn
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(F.length(digits).between(16, 19), card).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .when(kind == "id", F.length(digits) >= 4)
        .otherwise(True)
    )


def _blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x09-\x0D]", " ")


def _words(text: Column) -> Column:
    """The words of a text, in lower case, without signs at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), APART), lambda w: F.regexp_replace(w, r"^[_'\u2019-]++|(?<![_'\u2019-])[_'\u2019-]++$", "")), lambda w: w != "")


def _before(gap: Column) -> Column:
    """The last two words of the text before a match."""
    w = _words(F.substring_index(_blanks(gap), " ", -NEAR))
    return F.concat_ws(" ", F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), F.lit(2)))


def _after(gap: Column) -> Column:
    """The first word of the text behind a match."""
    return F.get(_words(F.substring_index(_blanks(gap), " ", NEAR)), F.lit(0))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a match: its word before, both words before, and the words on both sides."""
    own = F.split(before, " ")
    last = F.when(before != "", F.element_at(own, -1))
    return F.array_compact(F.array(last, F.when(F.size(own) == 2, before), F.concat(last, F.lit(" * "), after)))


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    """pattern, total: how often each word stands in the corpus."""
    chunks = docs.select(F.explode(F.split(F.lower(_blanks(F.coalesce(F.col(text), F.lit("")))), " +")).alias("chunk")).where("chunk <> ''").groupBy("chunk").agg(F.count("*").alias("n"))
    return chunks.select("n", F.explode(_words(F.col("chunk"))).alias("pattern")).groupBy("pattern").agg(F.sum("n").alias("total"))


def entities(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): numbered input rows, and their base entities and candidates (kind ``id``) with contexts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_no"), *[F.col(c).alias(f"in_{c}") for c in keep or []], *[found(body, p, _before, _after).alias(f"m_{k}") for k, p in PATTERNS.items()]), "personal-rows")
    some = rows.where(F.coalesce(*[f"m_{k}" for k in KINDS]).isNotNull())
    spans = None
    for k in KINDS:
        s = placed(some, ["row_no"], f"m_{k}").where(_valid(F.col("value"), F.lit(k))).withColumn("kind", F.lit(k))
        spans = s if spans is None else spans.unionByName(s)
    return rows, stored(spans.select("row_no", "kind", "start", "end", F.lower("value").alias("value"), _patterns(F.col("before"), F.col("after")).alias("patterns")), "personal-spans")


def _free(spans: DataFrame) -> DataFrame:
    """Candidates that no base entity of their row touches."""
    base = spans.where("kind <> 'id'").groupBy("row_no").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    ids = spans.where("kind = 'id'").join(base, "row_no", "left")
    return ids.where(F.col("taken").isNull() | ~F.exists("taken", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))).drop("taken")


def discovered(docs: DataFrame, spans: DataFrame, text: str = "text", confident: float = CONFIDENT, seeds: int = SEEDS) -> DataFrame:
    """Candidate spans that high-confidence patterns reveal: row_no, start, end, kind."""
    free = _free(spans)
    known = spans.where("kind <> 'id'").select(F.explode("patterns").alias("pattern"), "value", F.lit(1.0).alias("seed"))
    edges = stored(known.unionByName(free.select(F.explode("patterns").alias("pattern"), "value", F.lit(0.0).alias("seed"))).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "personal-edges")
    enough = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("seen")).where(F.col("values") >= seeds)  # others can never score
    # Words that a match cuts into may be fewer in the corpus than at matches; they occur as often as seen.
    total = F.greatest(F.coalesce("total", F.lit(0)), "seen").alias("total")
    patterns = stored(enough.join(_occurrences(docs, text), "pattern", "left").select("pattern", total), "personal-patterns")
    score = stored(edges.join(patterns, "pattern").select("pattern", "value", "seed", "n", "total", F.col("seed").alias("belief"), F.lit(0.0).alias("trust")), "personal-turn")
    signs = None
    while True:
        by_pattern = score.groupBy("pattern", "total").agg(F.when(F.count_if(F.col("belief") > 0) >= seeds, F.least(F.lit(1.0), F.sum(F.col("n") * F.col("belief")) / F.col("total"))).otherwise(0.0).alias("trust"))
        trusted = score.select("pattern", "value", "seed", "n", "total").join(by_pattern.select("pattern", "trust"), "pattern")
        by_value = trusted.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))).alias("reached"))
        turned = trusted.join(by_value, "value").select("pattern", "value", "seed", "n", "total", F.greatest("seed", F.when(F.col("reached") >= confident, F.col("reached")).otherwise(0.0)).alias("belief"), "trust")
        old, score = score, stored(turned, "personal-turn")
        dropped(old)
        now = [x or 0 for x in score.agg(F.count_if(F.col("belief") > 0), F.sum("trust"), F.sum("belief")).first()]
        if signs and now[0] == signs[0] and all(abs(x - y) <= SETTLED * max(1.0, abs(y)) for x, y in zip(now, signs, strict=True)):
            break
        signs = now
    good = score.where((F.col("trust") >= confident) & (F.col("seed") == 0)).select("pattern", "value").distinct()
    return free.withColumn("pattern", F.explode("patterns")).join(good, ["pattern", "value"], "left_semi").select("row_no", "kind", "start", "end").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans with those discovered."""
    rows, spans = entities(docs, text, [doc_id])
    every = spans.where("kind <> 'id'").select("row_no", "kind", "start", "end").unionByName(discovered(docs, spans, text))
    at = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    each = every.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "start", "kind", "end"))).alias("spans"))
    out = rows.select("row_no", F.col(f"in_{doc_id}").alias(doc_id)).join(each, "row_no", "left")
    n = lambda k: F.when(F.col("spans").isNull(), 0).otherwise(F.size(F.filter("spans", lambda s: s["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select(doc_id, *[n(k) for k in KINDS[:4]], F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "id")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("id").alias("n_discovered"))
