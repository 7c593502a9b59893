"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import (
    block_anchors, chat_format, decontamination, language_id, line_dedup, near_duplicates, packing, quality_classifier,
    quality_rules, spelling_variants, suffix_repeats, url_filters, vector_codes,
)
from tallyweave.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.noisy_urls(pages))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_repeats.delete_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "outlier", "distance")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract of this query counts shingles of four words.
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), near_duplicates.Scheme(shingle=4))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = block_anchors.delete_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat_format.control_conversation(turns))
    return chat_format.digests(chat_format.format_conversations(turns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_repeats": op2_suffix_repeats,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_block_anchors": op8_block_anchors,
    "op9_chat_format": op9_chat_format,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}

# DuckDB counterparts, where SQL can express the result.
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}
