"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample; the rules then run in the order of rejections per cost,
and the first one that rejects a row ends its way. The order never changes which rows pass, only what is computed.
Cost is work, not time: the characters and words that a rule's expressions pass over, counted on the sample's rows, so
that the order, and with it the rule named as rejecting, is the same in every run on the same rows.

``filtered`` runs the cascade itself: a row's words are split once, and a rule's measures only come to be if no rule
before it rejected. ``measured`` must return all measures of every row, so there the order decides only the name.

Defined results: null text has no words and is rejected; rows with equal or null ids are kept apart; an empty table
gives an empty result (the rules then keep their written order); further columns pass through ``filtered``; texts of
any length are read whole, each by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of rows, most rows on average, and seed of the sample on which costs and selectivities are estimated.
SAMPLE, SAMPLED, SEED = 0.01, 100_000, 7
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: What is long without being unbroken text: addresses, and scripts (with their punctuation) that set no blanks between words.
UNBROKEN = r"(?:https?|ftp)://[^\x09-\x0D\x20]+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\x{3000}-\x{303F}\x{30A0}-\x{30FF}\x{FF00}-\x{FFEF}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * 6), " "), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def long_words(text: Column, chars: Column, n: Column) -> Column:
    """Over 20 characters a word, also without addresses and scripts that set no blanks; the text is read again only then."""
    return (chars > 20 * n) & (word_chars(F.regexp_replace(text, UNBROKEN, "")) > 20 * n)


def n_dup_lines(text: Column) -> Column:
    x = lines(text)
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of ``value``, which is made once: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def keyed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        row = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.when(F.size(w) >= 3, F.sort_array(F.transform(at, row)))

    def repeats(s: Column) -> Column:
        same = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(r: Column) -> Column:
        return F.aggregate(F.transform(r, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return F.coalesce(_bound(_bound(_bound(words, keyed), repeats), covered), F.lit(0)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text (null as empty), _words, and the base measurements."""
    t = F.col("_text")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words(t))
    return df.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(F.col("_words"))})


def rules(text: Column, w: Column | None = None) -> dict[str, Column]:
    """Name and rejecting condition; the first two are the base rules. Nothing is rejected on the words' language.

    w: the text's words, where they are at hand.
    """
    w = words(text) if w is None else w
    n = F.size(w)
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * n_repeat_words(w) > 50 * n,
        "symbols": 10 * n_symbols(text) > 2 * word_chars(text),
        "repeated_lines": 2 * n_dup_lines(text) > F.size(lines(text)),
        "long_words": long_words(text, word_chars(text), n),
        "shouting": F.size(F.filter(w, lambda x: x.endswith("!!"))) * 2 > n,
    }


def costs(text: Column) -> dict[str, Column]:
    """Work of each rule on a row: characters passed over, and words handled, each of which counts as so many characters."""
    chars, n = F.length(text).cast("double"), F.size(words(text)).cast("double")
    return {
        "few_words": F.lit(1.0),  # the words are there
        "repeated_windows": n * (40 + 2 * F.log2(n + 1)),  # hashes, sorts and counts windows
        "symbols": 2 * chars,
        "repeated_lines": 3 * chars,
        "long_words": chars,
        "shouting": 4 * n,
    }


def ranked(docs: DataFrame, text: str = "text", share: float = SAMPLE, seed: int = SEED, most: int = SAMPLED) -> list[str]:
    """Names of the rules by rejections per work on a sample of about ``share`` of the rows, ``most`` of them at most on average."""
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).sample(fraction=min(share, most / n) if n else share, seed=seed)
    t = F.col("_text")
    checks, work = rules(t), costs(t)
    got = sample.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"bad_{k}") for k, c in checks.items()], *[F.round(F.avg(c)).alias(f"cost_{k}") for k, c in work.items()]).first()
    if not got["n"]:
        return list(checks)
    return sorted(checks, key=lambda k: -got[f"bad_{k}"] / max(1.0, got[f"cost_{k}"]))


def cascade(checks: dict[str, Column], order: list[str]) -> Column:
    """Name of the first check, in this order, that rejects; null if none does."""
    out = None
    for name in order:
        out = F.when(checks[name], name) if out is None else out.when(checks[name], name)
    return out


def measured(docs: DataFrame, text: str = "text", share: float = SAMPLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the base measurements, base_failed, kept and rejected_by.

    The rules read the measured columns here, so that nothing is computed twice.
    """
    order = ranked(docs, text, share, seed)
    df = features(docs, text)
    ready = {
        "few_words": F.col("n_words") < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > 2 * F.col("word_chars"),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.size(lines(F.col("_text"))),
        "long_words": long_words(F.col("_text"), F.col("word_chars"), F.col("n_words")),
        "shouting": F.size(F.filter("_words", lambda x: x.endswith("!!"))) * 2 > F.col("n_words"),
    }
    df = df.withColumn("rejected_by", cascade(ready, order))
    return df.withColumns({"base_failed": ready["few_words"] | ready["repeated_windows"], "kept": F.col("rejected_by").isNull()}).drop("_text", "_words")


def filtered(docs: DataFrame, text: str = "text", share: float = SAMPLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they were."""
    order = ranked(docs, text, share, seed)
    body = F.coalesce(F.col(text), F.lit(""))
    rejected = _bound(F.struct(body.alias("text"), words(body).alias("words")), lambda r: cascade(rules(r["text"], r["words"]), order))
    return docs.where(rejected.isNull())
