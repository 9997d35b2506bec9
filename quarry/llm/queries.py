"""The queries of this folder's operators, with production parameters, over whole tables; their SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, divergence, language, licenses, near_duplicates, oracles, packing, quality_rules, search, secrets, suffix_array_dedup, suffix_tree_dedup, token_counts, training_order
from quarry.llm.shared import shared_folder, table, texts
from quarry.llm.tokens import word_bpe


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_dedup.dedup(texts(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe()).drop("ids")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_order(table(spark, sf_dir, "documents"), word_bpe(), folder=f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), word_bpe())


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.dedup(texts(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(texts(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(texts(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(texts(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdict(quality_rules.ledger(texts(spark, sf_dir, "documents")), "standard/1")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(texts(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(texts(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_training_order": op3_training_order,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op5_suffix_array_dedup": oracles.OP5,
    "op6_ngram_jaccard_join": oracles.OP6,
    "op7_secret_scan": oracles.OP7,
    "op8_benchmark_decontamination": oracles.OP8,
    "op10_quality_rules": oracles.OP10,
    "op12_source_divergence": oracles.OP12,
    "op13_lexical_search": oracles.OP13,
}
