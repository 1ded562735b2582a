"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm import decontaminate, divergence, htmltext, lm, nearjoin, negatives, personal, quality, repeats, secrets, subwords, tokencount, tokenfiles
from tabguard.llm.shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.encoded(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ["doc_id"], digest=True)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents of one language are taken as a repository, the source as its owner."""
    return secrets.scan(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_scored(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.joined(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the next label counts."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.scaled(table(spark, sf_dir, "embeddings"), label), lambda: F.col("vec_id") % 100 == 0)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_secret_scan, op3_lm_scoring, op4_jaccard_join, op5_token_counts, op6_personal_data, op7_quality_rules, op8_decontaminate, op9_token_files, op10_html_text, op11_hard_negatives, op12_suffix_dedup, op13_source_divergence)}
ORACLES: dict[str, str] = {"op11_hard_negatives": negatives.MINED_SQL, "op13_source_divergence": divergence.AUDIT_SQL}
