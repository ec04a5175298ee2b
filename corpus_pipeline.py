"""Corpus pipeline: clean, deduplicate, decontaminate, redact and encode the documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and reread
as the next stage's documents. All stages but the last return the columns of ``documents``; the last
returns the token ids. ORACLE_SQL is None: line rules, components and Viterbi have no SQL form; the tests
hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kanon.llm.common import load, written
from kanon.llm.decontaminate import drop_contaminated
from kanon.llm.line_rules import clean_documents
from kanon.llm.ngram_jaccard import keep_one
from kanon.llm.pieces import encode_documents
from kanon.llm.secret_scan import redact_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject and the failing lines of the others."""
    return clean_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (5 words, similarity 0.8)."""
    return keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets."""
    return redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("sentencepiece", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
