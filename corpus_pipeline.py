"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, subword encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Stages but the last return
the columns of ``documents``; the last gives each kept document's sampled pieces, which decode to its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm import decontaminate, nearjoin, quality, secrets, subwords
from tabguard.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filtered(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near duplicates."""
    return nearjoin.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the sampled pieces of every document."""
    import public_tokenizers

    return subwords.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding", sentencepiece_encoding),
]
#: SQL cannot express the sampled segmentation of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
