"""Secret scan: credentials by pattern, told apart by how widely each value is copied across the corpus.

Every candidate value is hashed; the hashes are aggregated by distinct repositories and distinct owners. A value that
many repositories of many owners have is a published example; one that a few owners have is live-looking. How many
owners are many is at most ``EXAMPLE_OWNERS``, and half of all owners where there are fewer. The method also adds spans
of its own kind, ``key``: long mixed strings without a telling context that only few owners have.

Values that hold 1 / ``HOT`` of all spans or more are at most ``HOT`` and go to the spans by broadcast; the others are
joined by hash, so no copied value gathers its spans in one task.

Defined results: null text counts as empty and has no spans; null repositories and owners are not counted; rows with
equal or null ids are kept apart, one result each; an empty table gives an empty result; further columns of the input
are ignored by ``scan`` and kept by ``redact``. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import stored
from tabguard.llm.spans import found, joined, placed

# The patterns of the base kinds, in the order in which spans at one start are listed.
KINDS = ["assign", "access", "hex", "key"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "key": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
}
#: Of an assignment, the value itself (group 2 of the whole pattern); the match is kept if it has 8 or more characters.
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: With so many distinct owners and repositories, or those of half of all owners, a value counts as a published example.
EXAMPLE_OWNERS = 4
#: Most values whose classes are broadcast.
HOT = 1 << 16


def candidates(docs: DataFrame, text: str = "text", repository: str | Column = "source", owner: str | Column = "source", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): each input row with a number ``row_no``, and one row per candidate span with the hash of its value."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        *[F.col(c).alias(f"in_{c}") for c in keep or []],
        *[(F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for c, name in ((repository, "repository"), (owner, "owner"))],
        *[found(body, p).alias(f"m_{k}") for k, p in PATTERNS.items()],
    )
    rows = stored(numbered, "secret-rows")
    some = rows.where(F.coalesce(*[f"m_{k}" for k in KINDS]).isNotNull())
    spans = None
    for k in KINDS:
        s = placed(some, ["row_no", "repository", "owner"], f"m_{k}").withColumn("kind", F.lit(k))
        spans = s if spans is None else spans.unionByName(s)
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("value", _VALUE, 1)).otherwise(F.col("value"))
    spans = spans.withColumn("secret", secret).where((F.col("kind") != "assign") | (F.length("secret") >= 8))
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3)
    spans = spans.where((F.col("kind") != "key") | mixed)
    return rows, spans.select("row_no", "repository", "owner", "kind", "start", "end", F.sha2("secret", 256).alias("secret_hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """secret_hash, n_repositories, n_owners, n_seen of every candidate value in the corpus."""
    by = spans.groupBy("secret_hash", "repository", "owner").agg(F.count("*").alias("n"))
    return by.groupBy("secret_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_seen"))


def classified(docs: DataFrame, text: str = "text", repository: str | Column = "source", owner: str | Column = "source", example_owners: int = EXAMPLE_OWNERS, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, found): found has an array ``spans`` of (start, at, kind, end, live, n_owners) for each row_no with any.

    ``at`` is the kind's place in KINDS. A span of kind ``key`` stays only if it is live and no base span touches it.
    """
    rows, spans = candidates(docs, text, repository, owner, keep)
    spans = stored(spans, "secret-spans")
    owned = stored(ownership(spans), "secret-owners")
    every = spans.agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("n")).first()
    many = min(example_owners, max(2, -(-every["owners"] // 2)))
    classes = owned.select("secret_hash", "n_owners", "n_repositories", ((F.col("n_owners") < many) | (F.col("n_repositories") < many)).alias("live"), (F.col("n_seen") * HOT > every["n"]).alias("hot"))
    fields = F.struct("n_owners", "n_repositories", "live")
    hot, cold = (classes.where(F.col("hot") == x).select(F.col("secret_hash").alias(f"{k}_hash"), fields.alias(k)) for x, k in ((True, "often"), (False, "seldom")))
    dealt = spans.join(F.broadcast(hot), F.col("secret_hash") == F.col("often_hash"), "left")
    # Spans that have their class already get a key of their own, so that they spread.
    dealt = dealt.withColumn("key", F.when(F.col("often").isNull(), F.col("secret_hash")).otherwise(F.concat_ws(":", "row_no", "start")))
    dealt = dealt.join(cold, F.col("key") == F.col("seldom_hash"), "left")
    owned = dealt.select("row_no", "kind", "start", "end", F.coalesce("often", "seldom").alias("c")).select("row_no", "kind", "start", "end", "c.*")
    live = F.col("live")
    at = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    owned = owned.where((F.col("kind") != "key") | live)
    each = owned.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", at.alias("at"), "kind", "end", live.alias("live"), "n_owners"))).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] != "key")
    free = F.filter("spans", lambda s: (s["kind"] == "key") & ~F.exists(F.filter("spans", lambda b: b["kind"] != "key"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows, each.select("row_no", F.sort_array(F.concat(base, free)).alias("spans"), base.alias("base"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str | Column = "source", owner: str | Column = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans, and how many base spans look live."""
    rows, spans = classified(docs, text, repository, owner, example_owners, [doc_id])
    out = rows.select("row_no", F.col(f"in_{doc_id}").alias(doc_id)).join(spans, "row_no", "left")
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    none = lambda c: F.when(F.col("spans").isNull(), F.lit(0)).otherwise(c).cast("long")
    return out.select(
        doc_id,
        *[none(count(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        none(F.size(F.filter("base", lambda s: s["live"]))).alias("n_live"),
        none(F.size(F.filter("base", lambda s: ~s["live"]))).alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text", repository: str | Column = "source", owner: str | Column = "source", example_owners: int = EXAMPLE_OWNERS, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; columns as they were.

    Overlapping spans count as one. Published examples stay. Null text stays null.
    """
    rows, spans = classified(docs, text, repository, owner, example_owners, docs.columns)
    live = F.filter("spans", lambda s: s["live"])
    spans = spans.select("row_no", live.alias("live_spans")).where(F.size("live_spans") > 0)
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    merged = F.aggregate(
        "live_spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            s["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)),
            F.concat(F.slice(done, 1, F.size(done) - 1), span(F.element_at(done, -1)["start"], F.greatest(F.element_at(done, -1)["end"], s["end"]))),
        ).otherwise(F.concat(done, span(s["start"], s["end"]))),
    )
    spans = spans.select("row_no", merged.alias("live_spans"))
    whole = F.col(f"in_{text}")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("live_spans", i - 1)["end"])
    piece = lambda i: F.substring(whole, begin(i) + 1, F.coalesce(F.get("live_spans", i)["start"], F.length(whole)) - begin(i))
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size("live_spans")), piece), mark)
    out = rows.join(spans, "row_no", "left")
    return out.select(*[(F.when(F.col("live_spans").isNotNull(), cut).otherwise(F.col(f"in_{c}")) if c == text else F.col(f"in_{c}")).alias(c) for c in docs.columns])
