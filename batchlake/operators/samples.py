"""Sample sets: row-addressed (inputs, targets) with metadata."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.draws import draw
from . import batches
from .rowindex import with_row_index


@dataclass
class SampleSet:
    """A DataFrame with a dense 1-based `_idx`, the names of its inputs and targets, and what is known about it.

    Immutable: permute, cut and the like give new sets that share the plan.
    """

    df: DataFrame
    inputs: list[str]
    targets: list[str]
    shape: dict[str, tuple[int, ...]] = field(default_factory=dict)
    about: dict[str, object] = field(default_factory=dict)
    cursor: batches.Cursor = field(default_factory=batches.Cursor)
    _size: int | None = None

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str], inputs: list[str], targets: list[str], **more) -> SampleSet:
        return cls(with_row_index(df, order_by), inputs, targets, **more)

    def size(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    def take(self, positions: DataFrame) -> DataFrame:
        """Rows for positions (pos, _idx), in the order of pos and with repeats."""
        return positions.join(self.df, "_idx").orderBy("pos")

    def take_list(self, indices: list[int]) -> DataFrame:
        spark = self.df.sparkSession
        pos = spark.createDataFrame([(p, int(i)) for p, i in enumerate(indices, 1)], "pos long, _idx long")
        return self.take(pos)

    def between(self, start: int, stop: int) -> DataFrame:
        """Rows start..stop, both included."""
        return self.df.filter(F.col("_idx").between(start, stop))

    def draw(self, n: int, seed: str = "s") -> DataFrame:
        """n rows, uniformly and with replacement."""
        pos = self.df.sparkSession.range(1, n + 1).select(F.col("id").alias("pos"), (draw(seed, "id") % self.size() + 1).alias("_idx"))
        return self.take(pos)

    def permute(self, seed: str = "s") -> SampleSet:
        """The set in an order drawn from the seed; the old index is in `_was`."""
        d = self.df.withColumnRenamed("_idx", "_was").withColumn("_h", draw(seed, "_was"))
        return replace(self, df=with_row_index(d, ["_h", "_was"]).drop("_h"), cursor=batches.Cursor())

    def cut(self, ratio: float) -> tuple[SampleSet, SampleSet]:
        """The first floor(size * ratio) rows, and the rest numbered anew."""
        if not 0 < ratio < 1:
            raise ValueError("ratio must be between 0 and 1")
        n = math.floor(self.size() * ratio)
        first = self.df.filter(F.col("_idx") <= n)
        rest = self.df.filter(F.col("_idx") > n).withColumn("_idx", F.col("_idx") - n)
        new = lambda d, size: replace(self, df=d, _size=size, cursor=batches.Cursor())
        return new(first, n), new(rest, self.size() - n)

    def shape_of(self, columns: list[str], batch_first: bool = False) -> list[list[int]]:
        """Shape of a sample of each column; with the number of samples first if asked."""
        first = self.df.select(*(F.size(c).alias(c) if self.df.schema[c].dataType.typeName() == "array" else F.lit(-1).alias(c) for c in columns)).first()
        shapes = [list(self.shape.get(c, () if first is None or first[c] < 0 else (first[c],))) for c in columns]
        return [[self.size(), *s] if batch_first else s for s in shapes]

    def sequential_batches(self, batch: int = 32, epoch: int | None = None, wrap: str = "base") -> DataFrame:
        """Rows of the next epoch with (g, batch, pos, k); moves the cursor on."""
        n, size = batches.epoch_length(epoch, self.size()), self.size()
        plan = batches.sequential(self.df.sparkSession, size, batch, n, self.cursor.start, wrap)
        self.cursor.start = batches.next_cursor(self.cursor.start, n, size, wrap, batch)
        return batches.gather(self.df, plan)

    def random_batches(self, batch: int = 32, epoch: int | None = None, seed: str = "s") -> DataFrame:
        return batches.gather(self.df, batches.random(self.df.sparkSession, self.size(), batch, epoch, seed))

    def reset(self) -> None:
        self.cursor.reset()
