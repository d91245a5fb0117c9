"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontamination, embedding_dedup, hard_negatives, html_extraction, language_id, licenses, pii, quality, sharding, simhash, suffix_dedup
from .tables import read


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 24)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"), 3, 2)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(read(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"), 400)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), 30, 2000)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_sharding": op2_sharding,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op3_bpe": op3_bpe,
    "op10_decontamination": op10_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op1_html_extraction": op1_html_extraction,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op4_pii": op4_pii,
    "op6_license_scan": op6_license_scan,
    "op11_collocations": op11_collocations,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op6_license_scan": licenses.sql(),
    "op11_collocations": collocations.sql(),
    "op13_hard_negatives": hard_negatives.sql(),
}
