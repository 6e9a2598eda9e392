"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagescope.llm import byte_bpe, decontaminate, language_id, ngram_join, secret_scan, storage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or too far from every language learnt, go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, storage.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the byte-level BPE ids of the text."""
    out = byte_bpe.encode_column(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.selectExpr("doc_id", "cast(size(ids) AS long) AS n_tokens", "ids")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("byte_bpe", token_ids),
]

#: Language identification and tokens cannot be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
