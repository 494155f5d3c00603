"""A dense, 1-based row index in a given order, without one partition for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLED_KEYS = 20_000
BLOCK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is read in fewer than two partitions a core.

    A small table may be one row group of one file, and so one task; a large one stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def block_count(df: DataFrame) -> int:
    """How many blocks of about BLOCK_BYTES df makes: the partitions that it is read in, up to eight to each if the optimizer's estimate says that they are large."""
    parts, size = df.rdd.getNumPartitions(), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(parts, min(8 * parts, -(-size // BLOCK_BYTES)))


def _range_of(df: DataFrame, key: str, parts: int) -> Column | None:
    """Number of the range of `key` that a row is in; bounds are literals, from a bounded sample that one pass over the key draws."""
    if parts <= 1:
        return None
    keys = df.select(key).filter(F.col(key).isNotNull()).withColumn("__r", F.rand(5)).orderBy("__r").limit(SAMPLED_KEYS).select(key)
    got = sorted(r[0] for r in keys.collect())  # at most SAMPLED_KEYS values
    bounds = sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []
    if not bounds:
        return None
    edges = F.array(*(F.lit(b).cast(df.schema[key].dataType) for b in bounds))
    return F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col(key))), F.lit(0))


def _of_range(by_range: dict[int, object], kind: str) -> Column:
    """The value of a row's range, from one literal a range."""
    at = F.array(*(F.lit(by_range.get(k)).cast(kind) for k in range(max(by_range, default=0) + 1)))
    return F.get(at, F.col("__part"))


def with_row_index(df: DataFrame, order_by: list[str], name: str = "_idx", parts: int | None = None) -> DataFrame:
    """df with `name` = 1, 2, ... in the order of the columns order_by (ascending, nulls first).

    With more than one part, rows are ranked within ranges of the first key, whose
    bounds are literals of the plan, and ranges are shifted by the rows before them;
    so no task ever sees more than its range. Besides the pass that the result takes,
    two passes read the first key alone. `parts` defaults to the number of
    partitions that df is read in. Rows that tie in all keys are numbered in any
    order: give keys that are unique.
    """
    keys = [F.col(k).asc_nulls_first() for k in order_by]
    part = _range_of(df, order_by[0], df.rdd.getNumPartitions() if parts is None else parts)
    if part is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))
    before, n = {}, 0
    for r in df.select(part.alias("__part")).groupBy("__part").count().orderBy("__part").collect():  # one row a range
        before[r[0]] = n
        n += r[1]
    ranked = df.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return ranked.withColumn(name, (F.col("__rank") + _of_range(before, "long")).cast("long")).drop("__part", "__rank")


def with_offsets(df: DataFrame, order_by: list[str], size: Column, first: Column, kind: str, parts: int | None = None, block: str | None = None) -> tuple[DataFrame, int]:
    """(df with `_before` and `_following`, total): for rows that stand for `size` items each, one after another.

    _before: items of all rows before, in the order of order_by; _following: `first`
    (of type `kind`; null for a row without items) of the next row that has one;
    total: all items. As in with_row_index(), rows are ordered within ranges of the
    first key only; what crosses ranges are one sum and one value a range. `parts`
    defaults to block_count(); block: a column for the number of the row's range.
    """
    keys = [F.col(k).asc_nulls_first() for k in order_by]
    part = _range_of(df, order_by[0], block_count(df) if parts is None else parts)
    d = df.withColumns({"__size": size.cast("long"), "__first": first, "__part": F.lit(0) if part is None else part})
    has = F.when(F.col("__first").isNotNull(), F.struct(*order_by))
    stats = d.groupBy("__part").agg(F.sum("__size").alias("n"), F.min_by("__first", has).alias("first")).orderBy("__part").collect()  # one row a range
    before, n = {}, 0
    for r in stats:
        before[r[0]] = n
        n += r.n or 0
    after, ahead = {}, None
    for r in reversed(stats):
        after[r[0]] = ahead
        ahead = ahead if r.first is None else r.first
    w = Window.partitionBy("__part").orderBy(*keys)
    d = d.withColumns({"__upto": F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.expr("lead(__first) ignore nulls over (partition by __part order by " + ", ".join(f"`{k}` nulls first" for k in order_by) + ")")})
    d = d.withColumns({"_before": F.col("__upto") - F.col("__size") + _of_range(before, "long"), "_following": F.coalesce("__next", _of_range(after, kind))})
    if block is not None:
        d = d.withColumn(block, F.col("__part").cast("long"))
    return d.drop("__size", "__first", "__part", "__upto", "__next"), n


def run_boundaries(value: Column | str, order: list[str], partition: list[str] | None = None) -> Column:
    """1 where value differs from the row before (or is the first), else 0."""
    c = F.col(value) if isinstance(value, str) else value
    w = (Window.partitionBy(*partition) if partition else Window).orderBy(*order)
    return F.when(c.eqNullSafe(F.lag(c).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
