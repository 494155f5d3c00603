"""Operator 2: harmonic packing of documents into bins of a fixed token capacity.

A document of more than `capacity` tokens is cut into full pieces and a rest. A
piece of length in (capacity / (k + 1), capacity / k] is of class k, and any k
pieces of that class fit a bin, so a bin of class k takes exactly k pieces
(classes end at `classes`; shorter pieces share that last one). No bin needs to
know another's fill: each shard of `shard` consecutive doc_ids fills its own
bins, so shards are packed independently, whatever worker has them, and the
number of open bins at a shard's end is at most one a class.

Tokens are runs of characters other than blank, tab, line and form feed. A cut text's
pieces keep all that is between its tokens, so pieces in their order give the text again.

Cases: a text that is null or has no token takes no place; null doc_ids are a
shard of their own; repeated rows are packed each; ties keep to the order
(doc_id, piece, length); an empty table gives no rows; other columns are ignored.
doc_id is an integer, or can be cast to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CAPACITY, CLASSES, SHARD = 2048, 64, 4096
SPACE = r"[ \t\n\r\f]+"


def _placed(pieces: DataFrame, capacity: int, classes: int, shard: int, *ties: str) -> DataFrame:
    """pieces: doc_id, piece, n_tokens and others -> also shard, class, bin, slot, start."""
    d = pieces.withColumns({"shard": F.expr(f"floor(doc_id / {shard})").cast("long"), "class": F.expr(f"least({capacity} div n_tokens, {classes})").cast("long")})
    w = Window.partitionBy("shard", "class").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "n_tokens", *ties)
    d = d.withColumn("__r", F.row_number().over(w) - 1)
    d = d.withColumns({"bin": F.expr("__r div class").cast("long"), "slot": F.expr("__r % class").cast("long")}).drop("__r")
    before = Window.partitionBy("shard", "class", "bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _pieces(d: DataFrame, n: Column, capacity: int) -> DataFrame:
    d = d.withColumn("__n", n.cast("long")).filter("__n > 0")
    d = d.withColumn("piece", F.explode(F.expr(f"sequence(0L, (__n - 1) div {capacity})")))
    return d.withColumn("n_tokens", F.expr(f"least(__n - piece * {capacity}, {capacity})").cast("long")).drop("__n")


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, class, bin, slot, start): where each piece lies; only lengths are shuffled."""
    n = F.size(F.filter(F.split("text", SPACE), lambda x: x != ""))
    d = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("__n"))
    return _placed(_pieces(d, F.col("__n"), capacity), capacity, classes, shard).select("doc_id", "piece", "n_tokens", "shard", "class", "bin", "slot", "start")


def cut(text: str, capacity: int) -> Column:
    """Pieces of `capacity` tokens; what is before a token belongs to its piece, what is after the last one to the last."""
    gap, token = SPACE.replace("]+", "]"), SPACE.replace("[ ", "[^ ").replace("]+", "]")
    return F.regexp_extract_all(text, F.lit(rf"(?:{gap}*+{token}++){{1,{capacity}}}+(?:{gap}++\z)?+"), F.lit(0))


def packed_bins(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard: int = SHARD) -> DataFrame:
    """One row a bin: (shard, class, bin, n_docs, n_tokens, doc_ids, starts, text).

    doc_ids and starts go by slot; text is the pieces' texts as they are, with a
    form feed between pieces. Null texts and those without a token are in no bin;
    null doc_ids are a shard of their own; repeated rows are packed each; rows that
    tie in (doc_id, piece, length) go by their text; an empty table gives no rows.
    """
    d = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size(F.filter(F.split("text", SPACE), lambda x: x != "")).cast("long").alias("__n")).filter("__n > 0")
    one = d.filter(f"__n <= {capacity}").select("doc_id", F.lit(0).alias("piece"), "text", F.col("__n").alias("n_tokens"))
    more = d.filter(f"__n > {capacity}").select("doc_id", "__n", F.posexplode(cut("text", capacity)).alias("piece", "text"))
    more = more.select("doc_id", "piece", "text", F.least(F.col("__n") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"))
    placed = _placed(one.unionAll(more), capacity, classes, shard, "text")
    got = F.sort_array(F.collect_list(F.struct("slot", "doc_id", "start", "text")))
    out = placed.groupBy("shard", "class", "bin").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), got.alias("g"))
    return out.select("shard", "class", "bin", "n_docs", "n_tokens", F.col("g.doc_id").alias("doc_ids"), F.col("g.start").alias("starts"), F.array_join("g.text", "\f").alias("text"))


PACK_SQL = rf"""
with a as (select doc_id::BIGINT doc_id, len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> ''))::BIGINT n from documents where text is not null),
b as (select doc_id, n, unnest(generate_series(0, (n - 1) // {CAPACITY}))::BIGINT piece from a where n > 0),
c as (select doc_id, piece, least(n - piece * {CAPACITY}, {CAPACITY})::BIGINT n_tokens, floor(doc_id / {SHARD})::BIGINT shard from b),
d as (select *, least({CAPACITY} // n_tokens, {CLASSES})::BIGINT class from c),
e as (select *, row_number() over (partition by shard, class order by doc_id nulls first, piece, n_tokens) - 1 r from d),
f as (select *, (r // class)::BIGINT bin, (r % class)::BIGINT slot from e)
select doc_id, piece, n_tokens, shard, class, bin, slot,
  coalesce(sum(n_tokens) over (partition by shard, class, bin order by slot rows between unbounded preceding and 1 preceding), 0)::BIGINT as start
from f"""
