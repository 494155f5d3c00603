"""Rescaling, binarizing and per-channel normalization of array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def value_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Least and greatest element over all rows, without exploding the arrays."""
    r = df.agg(F.min(F.array_min(column)).alias("a"), F.max(F.array_max(column)).alias("b")).first()
    return float(r.a), float(r.b)


def rescale(column: Column | str, low: float, high: float, dmin: float, dmax: float) -> Column:
    """(x - dmin) * (high - low) * (1 / (dmax - dmin)) + low, in this order of operations, in double."""
    span, inverse = float(high - low), 1.0 / (dmax - dmin)
    return F.transform(column, lambda x: (x.cast("double") - F.lit(dmin)) * F.lit(span) * F.lit(inverse) + F.lit(float(low)))


def binarize(column: Column | str, threshold: float) -> Column:
    """x below the threshold becomes 0, then what is not below it becomes 1; so a threshold <= 0 gives 1 everywhere."""
    zeroed = lambda x: F.when(x < threshold, 0.0).otherwise(x)
    return F.transform(column, lambda x: F.when(zeroed(x.cast("double")) >= threshold, 1.0).otherwise(zeroed(x.cast("double"))))


def channel_stats(df: DataFrame, column: str, channels: int, batch: int = 32, index: str = "_idx", compat: bool = False) -> DataFrame:
    """(channel, mean, std): mean over batches of each batch's mean and sample deviation.

    Element i of an array of m belongs to channel i * channels div m. compat scales
    by batch / rows, right only where rows are a multiple of the batch.
    """
    d = df.select(F.floor((F.col(index) - 1) / batch).alias("b"), F.posexplode(column).alias("i", "x"), F.size(column).alias("m"))
    d = d.select("b", F.expr(f"cast(i * {channels} div m as bigint)").alias("channel"), F.col("x").cast("double").alias("x"))
    per = d.groupBy("b", "channel").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    if not compat:
        return per.groupBy("channel").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))
    n = df.count()
    return per.groupBy("channel").agg((F.sum("mean") * batch / n).alias("mean"), (F.sum("std") * batch / n).alias("std"))


def normalizer(stats: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function (df, column) -> df with (x - mean[c]) / std[c] for the channels of stats; one row a channel comes to the driver."""
    rows = sorted(stats.collect(), key=lambda r: r.channel)
    mean, std = F.array(*(F.lit(r["mean"]) for r in rows)), F.array(*(F.lit(r["std"]) for r in rows))

    def apply(df: DataFrame, column: str) -> DataFrame:
        c = lambda i: F.floor(i * len(rows) / F.size(column)).cast("int")
        return df.withColumn(column, F.transform(column, lambda x, i: (x.cast("double") - F.get(mean, c(i))) / F.get(std, c(i))))

    return apply
