"""Sequence layouts: one long sequence folded into columns; many packed into columns with mask rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


BLOCK = 1 << 18


def fold(sequence: DataFrame, columns: int, size: int | None = None) -> tuple[DataFrame, int]:
    """(lane, t, ...) for a sequence with `_idx`: column (_idx - 1) div S, time (_idx - 1) % S, S = size div columns.

    What is beyond S * columns is left out. Returns the frame and S.
    """
    n = sequence.count() if size is None else size
    s = n // columns
    p = F.col("_idx") - 1
    if s == 0:
        return sequence.filter("false").withColumns({"lane": p, "t": p}), 0
    return sequence.filter(F.col("_idx") <= s * columns).withColumns({"lane": F.floor(p / s).cast("long"), "t": (p % s).cast("long")}), s


def next_targets(folded: DataFrame, value: str, bidirectional: bool = False, block: int = BLOCK) -> DataFrame:
    """With `target`: the value one step on in the column (a column's last step has none and goes); bidirectional: the value itself.

    Blocks of consecutive `_idx` are tasks of their own, whatever the number of
    columns; the first row of a block is also sent to the block before.
    """
    if bidirectional:
        return folded.withColumn("target", F.col(value))
    p = F.col("_idx") - 1
    at = F.floor(p / block).cast("long")
    d = folded.withColumn("__block", F.explode(F.when((p % block == 0) & (p > 0), F.array(at, at - 1)).otherwise(F.array(at))))
    w = Window.partitionBy("__block").orderBy("_idx")
    d = d.withColumns({"target": F.lead(value).over(w), "__lane": F.lead("lane").over(w)})
    return d.filter((F.col("__block") == at) & (F.col("__lane") == F.col("lane"))).drop("__block", "__lane")


def known_targets(folded: DataFrame, steps: int, following: str = "following") -> DataFrame:
    """As next_targets() for a sequence that carries each value's follower: no row moves. `steps` is the length of a column."""
    return folded.filter(F.col("t") < steps - 1).withColumnRenamed(following, "target")


def runs(texts: DataFrame, columns: int, size: int, of: Callable[[Column, Column], Column], width: int | None = None, targets: bool = False, whole: bool | None = None) -> DataFrame:
    """(lane, batch, t, steps, whole, value) for texts (words, _before) of a sequence of `size` words that is folded into columns.

    One row for each part of a text that lies in one column and, if width is given, in
    one batch of `width` steps; value is of(place in the text from 1, steps). targets:
    a column's last step, which has no next word, goes. `whole` tells whether the text
    has all steps of the batch; the argument keeps only such rows, or only others. So
    words move as parts of texts, or not at all.
    """
    s = size // columns
    width = width or max(s, 1)
    per, b = -(-s // width), F.col("_before")
    e = F.least(b + F.size("words"), F.lit(s * columns))
    number = lambda p: F.floor(p / s).cast("long") * per + F.floor(p % s / width).cast("long")

    def run(g: Column) -> Column:
        lane = F.floor(g / per).cast("long")
        first = lane * s + g % per * width
        end = F.least(first + width, (lane + 1) * s - int(targets))
        low = F.greatest(b, first)
        n = F.least(e, end) - low
        wanted = n > 0 if whole is None else (n > 0) & ((n == end - first) == F.lit(whole))
        return F.struct(
            lane.alias("lane"), (g % per).alias("batch"), (low - lane * s).alias("t"), n.alias("steps"), (n == end - first).alias("whole"),
            F.when(wanted, of((low - b + 1).cast("int"), n.cast("int"))).alias("value"),
        )

    if s == 0:
        texts, s, per = texts.filter("false"), 1, 1
    return texts.select(F.explode(F.when(e > b, F.transform(F.sequence(number(b), number(e - 1)), run))).alias("__run")).select("__run.*").filter("steps > 0" if whole is None else f"steps > 0 and whole = {whole}")


def fold_size(steps: int, bidirectional: bool = False) -> int:
    return steps if bidirectional else steps - 1


@dataclass
class PackState:
    """Which sequence is next (from 1) and what each column has under way: (sequence, offset) or None."""

    next_seq: int = 1
    columns: list[tuple[int, int] | None] = field(default_factory=list)


def plan_pack(slots: list[int], columns: int, chunk: int, steps: int, state: PackState | None = None, choose: Iterator[int] | None = None) -> tuple[list[tuple[int, int, int, int, int, bool]], PackState]:
    """Runs (lane, t, n, seq, offset, is_mask) that fill `steps` time steps of each column, chunk by chunk.

    A column without a sequence writes one mask, claims the next sequence (round
    robin, or as `choose` says) and takes its slots - 1 further places. Chunks go
    first, then columns, then time, and what is unfinished goes on in the next chunk.
    Only lengths are planned; the data stay distributed.
    """
    state = PackState(state.next_seq, list(state.columns)) if state else PackState(1, [None] * columns)
    runs, n = [], len(slots)
    for begin in range(0, steps, chunk):
        width = min(chunk, steps - begin)
        for c in range(columns):
            at = 0
            while at < width:
                if state.columns[c] is None:
                    runs.append((c, begin + at, 1, 0, 0, True))
                    at += 1
                    if choose is None:
                        state.columns[c] = (state.next_seq, 0)
                        state.next_seq = state.next_seq % n + 1
                    else:
                        state.columns[c] = (next(choose), 0)
                seq, off = state.columns[c]
                take = min(width - at, slots[seq - 1] - 1 - off)
                if take > 0:
                    runs.append((c, begin + at, take, seq, off, False))
                    at += take
                    off += take
                state.columns[c] = None if off >= slots[seq - 1] - 1 else (seq, off)
    return runs, state


def packed_size(total_slots: int, columns: int) -> int:
    return -(-total_slots // columns)


def pack_columns(sequences: DataFrame, columns: int, chunk: int, steps: int | None = None, state: PackState | None = None, shifted: bool = True, seed: int | None = None) -> tuple[DataFrame, PackState]:
    """(lane, t, seq, input, target, is_mask) for sequences (seq from 1, values); mask rows have input 0 and target 1.

    Values are numbers, or arrays (of arrays) of numbers of one shape, such as frames; a mask is filled in that shape.
    shifted: inputs and targets are neighbours (x[j], x[j + 1]) and a sequence of L
    values has L slots; else they are aligned and it has L + 1, masks 0 for both.
    seed: the next sequence is drawn at random.
    """
    spark = sequences.sparkSession
    lengths = [r[0] for r in sequences.select(F.size("values").alias("n"), "seq").orderBy("seq").select("n").toLocalIterator()]
    slots = [n if shifted else n + 1 for n in lengths]
    steps = packed_size(sum(slots), columns) if steps is None else steps
    choose = None
    if seed is not None:
        import random

        rng = random.Random(seed)
        choose = iter(lambda: rng.randint(1, len(slots)), 0)
    runs, after = plan_pack(slots, columns, chunk, steps, state, choose)
    frame = pd.DataFrame(runs, columns=["lane", "t", "n", "seq", "offset", "is_mask"])
    plan = spark.createDataFrame(frame, "lane long, t long, n long, seq long, offset long, is_mask boolean")
    d = plan.join(sequences, "seq", "left").withColumn("j", F.explode(F.expr("sequence(0L, n - 1)")))
    at = (F.col("offset") + F.col("j")).cast("int")
    kind, like = sequences.schema["values"].dataType.elementType, sequences.select(F.filter("values", lambda x: x.isNotNull())[0].alias("x")).filter("x is not null").first()
    value = lambda i, mask: F.when(F.col("is_mask"), _filled(None if like is None else like.x, mask).cast(kind)).otherwise(F.get("values", i))
    return d.select(
        "lane", (F.col("t") + F.col("j")).alias("t"), "seq", value(at, 0).alias("input"), value(at + 1 if shifted else at, int(shifted)).alias("target"), "is_mask",
    ), after


def _filled(like: object, value: int) -> Column:
    """`value` in the shape of `like`, which is a number or a nested array."""
    if isinstance(like, (list, tuple)):
        return F.array_repeat(_filled(like[0] if like else None, value), len(like))
    return F.lit(value)


def single_column(sequences: DataFrame, length: str = "n") -> DataFrame:
    """(seq, n, t) of sequences (seq, n): with one column the mask before each stands at the running sum of lengths."""
    w = Window.orderBy("seq")
    return sequences.withColumn("t", (F.sum(length).over(w) - F.col(length)).cast("long"))
