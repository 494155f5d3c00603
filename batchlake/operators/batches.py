"""Batch plans of an epoch as closed forms: which row is in which batch, without a loop.

A sequential epoch of `epoch` draws starts at a 1-based cursor, goes on to the
end of the set and wraps to row 1; a batch ends at the batch size, at the set's
end, and at the epoch's end. `k` is how many rows the epoch has given so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.draws import draw


@dataclass
class Cursor:
    """Where the next sequential epoch starts."""

    start: int = 1

    def reset(self) -> None:
        self.start = 1


def epoch_length(epoch: int | None, size: int) -> int:
    """None, 0 and negative lengths mean the whole set."""
    return size if epoch is None or epoch <= 0 else epoch


def next_cursor(start: int, epoch: int, size: int, wrap: str = "base", batch: int = 1) -> int:
    if wrap == "base":
        return (start - 1 + epoch) % size + 1
    first, later = early_laps(start, batch, size)
    done = first - start + 1
    after = start + epoch if epoch < done else (epoch - done) % later + 1
    return after if after < size else 1


def early_laps(start: int, batch: int, size: int) -> tuple[int, int]:
    """Last rows of the first and of later laps under the `early` rule, which wraps on reaching the last row."""
    first = size - 1 if (size - start) % batch == 0 and start < size else size
    later = size - 1 if size > 1 and (size - 1) % batch == 0 else size
    return first, later


def sequential(spark: SparkSession, size: int, batch: int = 32, epoch: int | None = None, start: int = 1, wrap: str = "base") -> DataFrame:
    """(g, _idx, lap, batch, pos, k): draw g (from 0) takes row _idx as place pos of a batch numbered from 0."""
    if not 1 <= start <= size or batch < 1 or wrap not in ("base", "early"):
        raise ValueError("start must be within the set, batch positive, wrap `base` or `early`")
    n = epoch_length(epoch, size)
    first, later = (size, size) if wrap == "base" else early_laps(start, batch, size)
    head = first - start + 1
    per_head, per_lap = -(-head // batch), -(-later // batch)
    g = F.col("g")
    lap = F.when(g < head, F.lit(0)).otherwise(F.floor((g - head) / later) + 1).cast("long")
    d = spark.range(n).select(F.col("id").alias("g")).withColumn("lap", lap)
    off = F.when(F.col("lap") == 0, g).otherwise((g - head) % later)
    d = d.withColumn("__off", off.cast("long"))
    idx = F.when(F.col("lap") == 0, F.col("__off") + start).otherwise(F.col("__off") + 1)
    number = F.when(F.col("lap") == 0, F.floor(F.col("__off") / batch)).otherwise(per_head + (F.col("lap") - 1) * per_lap + F.floor(F.col("__off") / batch))
    lap_end = F.when(F.col("lap") == 0, F.lit(head)).otherwise(head + F.col("lap") * later)
    begin = g - F.col("__off") % batch
    k = F.least(begin + batch, lap_end, F.lit(n))
    return d.select("g", idx.cast("long").alias("_idx"), "lap", number.cast("long").alias("batch"), (F.col("__off") % batch).cast("long").alias("pos"), k.cast("long").alias("k"))


def random(spark: SparkSession, size: int, batch: int = 32, epoch: int | None = None, seed: str = "s") -> DataFrame:
    """(g, _idx, batch, pos, k): rows with replacement; the last batch is cut at the epoch's end."""
    n = epoch_length(epoch, size)
    g = F.col("g")
    return spark.range(n).select(F.col("id").alias("g")).select(
        "g", (draw(seed, "g") % size + 1).alias("_idx"), F.floor(g / batch).cast("long").alias("batch"), (g % batch).alias("pos"), F.least((F.floor(g / batch) + 1) * batch, F.lit(n)).cast("long").alias("k"),
    )


def gather(samples: DataFrame, plan: DataFrame, small_plan: bool = False) -> DataFrame:
    """Rows of samples by the plan's _idx, repeated as often as it names them; order by `g` or `pos` is the caller's."""
    return samples.join(F.broadcast(plan) if small_plan else plan, "_idx")


def as_batches(rows: DataFrame, inputs: list[str], extra: list[Column] | None = None) -> DataFrame:
    """One row a batch: (batch, k, n, rows) with rows in the order of pos."""
    got = F.sort_array(F.collect_list(F.struct("pos", *inputs)))
    return rows.groupBy("batch", "k").agg(F.count("*").alias("n"), got.alias("rows"), *(extra or []))


def prefetched(batches: DataFrame, order: str = "batch") -> Iterator:
    """Batches one after the other; the next partitions are computed while one is consumed."""
    return batches.orderBy(order).toLocalIterator(prefetchPartitions=True)
