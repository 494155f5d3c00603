"""Queries of this subpackage for the driver: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, mixing, nbsvm, neighbours, packing, quality, simhash, substring, toxicity
from .durable import parquet


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(parquet(spark, sf_dir, "documents"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op4_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(parquet(spark, sf_dir, "embeddings"), every=50)


def op5_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(parquet(spark, sf_dir, "conversations"))


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ledger(parquet(spark, sf_dir, "documents"))


def op7_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(parquet(spark, sf_dir, "documents")))


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op9_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(parquet(spark, sf_dir, "documents")).select("doc_id", "start", "end", "kept_doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(parquet(spark, sf_dir, "documents")).select("doc_id", "kept_doc_id", "group_size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_harmonic_packing, op3_toxicity, op4_posting_list_neighbours, op5_mixing_rates, op6_chat_perspectives, op7_quality_ledger, op7_quality_ablation, op8_nbsvm_quality, op9_substring_repeats, op10_simhash)
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.SCAN_SQL,
    "op2_harmonic_packing": packing.PACK_SQL,
    "op6_chat_perspectives": chat.PERSPECTIVES_SQL,
    "op7_quality_ledger": quality.LEDGER_SQL,
    "op7_quality_ablation": quality.ABLATION_SQL,
}
