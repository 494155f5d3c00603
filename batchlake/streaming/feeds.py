"""Batches from a stream of files: the epoch cursor of a set that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they come, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """(start, keys, n) by tumbling windows; rows later than the watermark are left out."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def feed(stream: DataFrame, order_by: list[str], batch: int, use: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls use(rows with `batch` and `pos`, micro-batch number) for all that is there, then ends; goes on from its checkpoint."""

    def each(d: DataFrame, number: int) -> None:
        from ..operators.rowindex import with_row_index

        rows = with_row_index(d, order_by)
        i = F.col("_idx") - 1
        use(rows.withColumns({"batch": F.floor(i / batch).cast("long"), "pos": (i % batch).cast("long")}), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
