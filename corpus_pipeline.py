"""A corpus pipeline of five stages, each one of the operators of quarry.llm with its decisions in effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with the columns
they came with.  Nulls, empty and repeated documents are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, near_duplicates, packing, quality_rules, secrets
from quarry.llm.shared import materialise, table, texts
from quarry.llm.tokens import word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, "standard/1")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_duplicates.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences: a row for each piece, with its ids and its place."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicate),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL has no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each stage's result written and read again."""
    docs = texts(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
