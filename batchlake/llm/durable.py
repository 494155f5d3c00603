"""Cutting lineage in storage that every executor shares, and carrying whole rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept by a reliable checkpoint.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only where
    that is unset and all executors are threads of this process, as in tests, a
    temporary folder is made; on a cluster an unset folder is an error, as other
    machines would not see it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names used by an operator can't clash with them."""
    return F.struct(*(quoted(c) for c in df.columns))


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The columns of whole_row() again."""
    return df.select([F.col(row).getField(c).alias(c) for c in names])
