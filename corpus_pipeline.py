"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchlake.llm import mixing, packing, quality, simhash, substring
from batchlake.llm.durable import durable, parquet


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v3 of the rules rejects go."""
    return quality.keep_good(docs, "v3")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut out but for their first copy."""
    return substring.remove_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out so that domains meet their token targets."""
    return mixing.mix(docs, parquet(spark, sf_dir, "labels"))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of packed documents, with their texts."""
    return packing.packed_bins(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixing", source_mixing),
    ("harmonic packing", harmonic_packing),
]

#: Stages 2 to 4 are searches, components and an iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is computed once and kept in the shared folder."""
    docs = parquet(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
