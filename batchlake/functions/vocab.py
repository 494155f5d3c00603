"""Words, vocabularies, encodings and bigram models."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators.rowindex import block_count, spread, with_offsets
from . import lookup

SPACE = r"[ \t\n\r\f]+"
OOV = "<OOV>"


def tokens(text: Column | str, separator: str = SPACE) -> Column:
    """Words of a text; empty ones are dropped."""
    return F.filter(F.split(text, separator), lambda w: w != "")


def split_chars(text: Column | str, separators: str = ":") -> Column:
    """Parts between any of the characters in `separators`, without empty ones."""
    return tokens(text, "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", separators) + "]")


def lines_to_words(text: Column | str, compat: bool = False) -> Column:
    """Words of a text whose line ends are the word `<eos>`; compat relies on blanks around them."""
    return tokens(F.replace(text, F.lit("\n"), F.lit("<eos>" if compat else " <eos> ")))


def exploded(df: DataFrame, keys: list[str], text: str, separator: str = SPACE, limit: int | None = None, outer: bool = False) -> DataFrame:
    """(keys, pos, word), one row a word, pos from 0; of each text the first `limit` words.

    outer: a text that is null or has no word gives a row with pos and word null.
    """
    words = tokens(text, separator)
    return spread(df.select(*keys, text)).select(*keys, (F.posexplode_outer if outer else F.posexplode)(words if limit is None else F.slice(words, 1, limit)).alias("pos", "word"))


def _offsets(df: DataFrame, order_by: list[str], text: str, block: str | None = None) -> tuple[DataFrame, int]:
    word = SPACE.replace("[ ", "[^ ")
    d = df.select(*order_by, F.col(text).alias("__text"))
    parts = max(block_count(d), d.sparkSession.sparkContext.defaultParallelism)  # which also deals a small table out
    return with_offsets(d, order_by, F.coalesce(F.regexp_count("__text", F.lit(word)), F.lit(0)), F.nullif(F.regexp_extract("__text", word, 0), F.lit("")), "string", parts, block)


def text_stream(df: DataFrame, order_by: list[str], text: str) -> tuple[DataFrame, int]:
    """((order_by, words, _before, _following), size): texts as parts of one sequence of words, in the order of order_by.

    _before: words of all texts before; _following: the first word after the text, null at the end.
    Texts move once, to be ordered within ranges; words never do.
    """
    d, size = _offsets(df, order_by, text)
    return d.select(*order_by, F.coalesce(tokens("__text"), F.array().cast("array<string>")).alias("words"), "_before", "_following"), size


def word_stream(df: DataFrame, order_by: list[str], text: str) -> tuple[DataFrame, int]:
    """((order_by, pos, word, following, _idx), size): text_stream() with one row a word; _idx is from 1, following is the next word."""
    d, size = text_stream(df, order_by, text)
    n = F.size("words")
    ahead = F.concat(F.slice("words", 2, F.greatest(n, F.lit(1))), F.array("_following"))
    both = F.when(n > 0, F.arrays_zip(F.col("words").alias("word"), ahead.alias("following")))
    d = d.select(*order_by, "_before", F.posexplode(both).alias("pos", "__w"))
    return d.select(*order_by, "pos", F.col("__w.word").alias("word"), F.col("__w.following").alias("following"), (F.col("_before") + F.col("pos") + 1).alias("_idx")), size


def frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def vocabulary(freq: DataFrame, min_freq: int = -1, oov: str = "last") -> DataFrame:
    """(word, id, freq), ids in the words' binary order.

    oov = "last": ids from 1, and `<OOV>` with the dropped words' total comes last if
    any was dropped. oov = "first": `<OOV>` is 1, whether needed or not, words go on
    from 2. A word `<OOV>` of the text is not kept as a word of its own. Words are
    ranked among those that begin with the same two bytes.
    """
    # one condition on freq, so that no part of it sinks below the count and makes another plan of it
    d = freq.withColumn("keep", F.when(F.col("word") == OOV, False).otherwise(F.col("freq") >= min_freq))
    kept = d.filter("keep").withColumn("__part", F.hex(F.substring(F.col("word").cast("binary"), 1, 2)))
    sizes = kept.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))  # a row a beginning, 65,793 at most
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("word"))).join(F.broadcast(before), "__part")
    ranked = ranked.select("word", (F.col("__rank") + F.col("__before") + (1 if oov == "first" else 0)).cast("long").alias("id"), "freq")
    out = d.filter("not keep").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"), F.count("*").alias("n"))
    if oov == "first":
        return ranked.unionAll(out.select(F.lit(OOV), F.lit(1).cast("long"), "freq"))
    n = kept.agg(F.count("*").alias("kept"))
    return ranked.unionAll(out.crossJoin(n).filter("n > 0").select(F.lit(OOV), (F.col("kept") + 1).cast("long"), "freq"))


def encode(words: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """words (..., word) with `id`; an unknown word gets the id of `<OOV>`, or is an error if strict or there is no such id; a null word has none.

    A plain equi-join: the optimizer broadcasts the vocabulary if it is small enough; beyond that
    frequent words are split at run time as skewed partitions are.
    """
    known = vocab.filter(F.col("word") != OOV).select("word", "id")
    other = vocab.agg(F.max(F.when(F.col("word") == OOV, F.col("id"))).alias("__oov"))
    d = words.join(known, "word", "left").crossJoin(F.broadcast(other))  # one row
    missing = F.raise_error(F.concat(F.lit("not in the vocabulary: "), "word")).cast("long")
    return d.withColumn("id", F.when(F.col("word").isNotNull(), F.coalesce("id", missing) if strict else F.coalesce("id", "__oov", missing))).drop("__oov")


def _keyed(df: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """df with `__block`, a number below `blocks` by its keys, and dealt out by it."""
    return df.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(blocks).cast("long"))).repartition(blocks, "__block")


def _looked_up(texts: DataFrame, known: DataFrame, of: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """of(rows of a block, what `known` has for it), block by block."""

    def block(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = of(rows, found)
        lookup.release()
        return out

    return texts.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(block, schema)


def _block_words(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(__block, word, id) for the words of each block's texts (__block, __text)."""
    words = texts.mapInArrow(lookup.distinct_words, "__block long, word string").repartition("word").dropDuplicates(["word", "__block"])
    return encode(words, vocab)


def encode_texts(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, limit: int | None = None, blocks: int | None = None) -> DataFrame:
    """(keys, ids): as sequences(encode(exploded(df))) for keys that are unique; of each text the first `limit` words.

    Texts move once, to blocks of bounded size; what meets the vocabulary are the distinct words of each block.
    """
    d = _keyed(df.select(*keys, F.col(text).alias("__text")), keys, block_count(df) if blocks is None else blocks)
    schema = StructType([*(d.schema[k] for k in keys), StructField("ids", ArrayType(LongType()))])

    def of(texts: pa.Table, known: pa.Table) -> pa.Table:
        return texts.select(keys).append_column("ids", lookup.text_ids(lookup.one(texts.column("__text")), known, limit)) if texts.num_rows else pa.table({k: [] for k in schema.names})

    return _looked_up(d, _block_words(d, vocab), of, schema)


def padded(ids: Column | str, length: int) -> Column:
    """The first `length` ids, with zeros before them."""
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), length - F.size(ids))), F.slice(ids, 1, length))


def sequences(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids) in the order of pos; rows without an id only keep their keys there."""
    return encoded.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]).alias("ids"))


def decode(rows: DataFrame, keys: list[str], ids: str, vocab: DataFrame, blocks: int | None = None) -> DataFrame:
    """(keys, text) for keys that are unique: the words of the ids above 0, joined by blanks; empty where there is none.

    As in encode_texts(), rows move once, to `blocks` blocks (else as many as there
    are shuffle partitions), and distinct ids of each block meet the vocabulary.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if blocks is None else blocks
    d = _keyed(rows.select(*keys, F.col(ids).cast("array<bigint>").alias("__ids")), keys, blocks)
    schema = StructType([*(d.schema[k] for k in keys), StructField("text", StringType())])
    used = d.mapInArrow(lookup.distinct_ids, "__block long, id long").repartition("id").dropDuplicates(["id", "__block"])
    known = used.join(vocab.select("id", "word"), "id").select("__block", "id", "word")

    def of(lists: pa.Table, known: pa.Table) -> pa.Table:
        return lists.select(keys).append_column("text", lookup.id_texts(lookup.one(lists.column("__ids")), known)) if lists.num_rows else pa.table({k: [] for k in schema.names})

    return _looked_up(d, known, of, schema)


def unigram(vocab: DataFrame) -> DataFrame:
    """(id, freq)."""
    return vocab.select("id", "freq")


def bigrams(pairs: DataFrame) -> DataFrame:
    """(cur, next, freq, prob) of pairs (cur, next); prob is of next given cur."""
    c = pairs.groupBy("cur", "next").agg(F.count("*").alias("freq"))
    return c.withColumn("prob", F.col("freq") / F.sum("freq").over(Window.partitionBy("cur")))


def text_bigrams(df: DataFrame, order_by: list[str], text: str, vocab: DataFrame, columns: int) -> DataFrame:
    """bigrams() of the ids of all texts' words, as one sequence that is folded into columns (a column's last word has no next).

    Pairs are counted in each block of texts; each count then moves once, to the others of its first word.
    """
    d, size = _offsets(df, order_by, text, "__block")
    d = d.select("__block", "_before", F.concat_ws(" ", "__text", "_following").alias("__text"))
    steps = size // columns

    def of(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("cur", "next", "freq")})
        return lookup.pair_counts(texts.column("_before").to_numpy(), lookup.text_ids(lookup.one(texts.column("__text")), known), columns, steps)

    c = _looked_up(d, _block_words(d, vocab), of, "cur long, next long, freq long").repartition("cur")
    return c.groupBy("cur", "next").agg(F.sum("freq").alias("freq")).withColumn("prob", F.col("freq") / F.sum("freq").over(Window.partitionBy("cur")))


def bigram_lists(model: DataFrame) -> DataFrame:
    """(cur, nexts): one row a word with its followers and their probabilities."""
    return model.groupBy("cur").agg(F.sort_array(F.collect_list(F.struct("next", F.col("prob").cast("float")))).alias("nexts"))


def polarity(column: Column | str) -> Column:
    """0 -> 1, 4 -> 2, 2 -> null (to be dropped), else an error."""
    c = F.col(column) if isinstance(column, str) else column
    wrong = F.raise_error(F.concat(F.lit("unknown polarity: "), c.cast("string"))).cast("long")
    return F.when(c == 0, F.lit(1).cast("long")).when(c == 4, F.lit(2).cast("long")).when(c == 2, F.lit(None).cast("long")).otherwise(wrong)


def field(line: Column | str, number: int) -> Column:
    """The number-th (from 1) run of characters other than `"` and `,`; null if there is none."""
    return F.get(F.filter(F.split(line, '[",]+'), lambda x: x != ""), number - 1)
