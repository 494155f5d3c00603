"""Text corpora, sentence tables, message files, numeric sets, caches and local archives."""

from __future__ import annotations

import gzip
import os
import shutil
import socket
import tarfile
import time
import uuid
import zipfile
from collections.abc import Callable
from contextlib import chdir
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numeric, tweets, vocab
from ..operators.rowindex import run_boundaries, with_row_index
from ..operators.samples import SampleSet

START_ID, END_ID = 793470, 793471


@dataclass
class Paths:
    """Where data and results lie: from the environment, with folders under the home as defaults."""

    data: str
    save: str

    @classmethod
    def from_env(cls, make: bool = False) -> Paths:
        home = os.environ.get("BATCHLAKE_HOME") or os.environ.get("HOME", ".")
        p = cls(os.environ.get("BATCHLAKE_DATA") or f"{home}/data", os.environ.get("BATCHLAKE_SAVE") or f"{home}/save")
        if make:
            for d in (p.data, p.save):
                os.makedirs(d, exist_ok=True)
        return p


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The Parquet table at path; made and written first where it is absent or to be overwritten."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_any(spark: SparkSession, path: str, formats: tuple[str, ...] = ("json", "parquet")) -> DataFrame:
    """The table at path in the first of the formats that reads it."""
    last: Exception | None = None
    for f in formats:
        try:
            d = spark.read.format(f).load(path)
            if "_corrupt_record" in d.columns:
                raise ValueError(f"{path} is not {f}")
            return d
        except Exception as e:  # noqa: BLE001  another format may read it
            last = e
    raise ValueError(f"no format of {formats} reads {path}") from last


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def text_corpus(spark: SparkSession, train: str, others: dict[str, str], min_freq: int = -1, compat: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """({name: (_idx, word, id)}, vocabulary) of line files; the vocabulary is of the train file only.

    A line end is the word `<eos>`. Words of other files that the vocabulary lacks are `<OOV>`, or an error without one.
    """

    def words(path: str) -> DataFrame:
        d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(vocab.lines_to_words("value", compat)).alias("pos", "word"))
        return with_row_index(d, ["f", "pos"]).select("_idx", "word")

    files = {"train": train, **others}
    sets = {name: words(path) for name, path in files.items()}
    v = vocab.vocabulary(vocab.frequency(sets["train"]), min_freq)
    return {name: vocab.encode(d, v) for name, d in sets.items()}, v


def sentences(rows: DataFrame, start_id: int | None = START_ID, end_id: int | None = END_ID) -> DataFrame:
    """(seq, start, values) of rows (pos, start_id, word_id): one array a run of equal start ids, with the start word before it.

    A sentence that doesn't end on end_id is an error. Runs follow the order of pos.
    """
    d = rows.withColumn("__run", F.sum(run_boundaries("start_id", ["pos"])).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(F.col("__run").cast("long").alias("seq")).agg(F.min("start_id").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "word_id"))), lambda x: x["word_id"]).alias("values"))
    if end_id is not None:
        ok = F.element_at("values", -1) == end_id
        g = g.withColumn("values", F.when(ok, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("no end in sentence "), F.col("seq").cast("string"))).cast(g.schema["values"].dataType)))
    return g if start_id is None else g.withColumn("values", F.concat(F.array(F.lit(start_id).cast("long")), "values"))


def keyed_sentences(rows: DataFrame, key: str, order: str, word: str) -> DataFrame:
    """As sentences(), where each sentence has a key of its own: no global order is needed."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, word))), lambda x: x[word]).alias("values"))


def message_lines(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """(polarity, text) of a 6-field file. By default fields are runs without quotes and commas, so a text ends at its first; clean reads real CSV."""
    if clean:
        d = spark.read.csv(path, quote='"', escape='"').toDF("polarity", "id", "date", "query", "user", "text")
        return d.select(F.col("polarity").cast("int").alias("polarity"), "text")
    d = spark.read.text(path)
    return d.select(vocab.field("value", 1).cast("int").alias("polarity"), vocab.field("value", 6).alias("text")).filter("text is not null")


def encoded_messages(messages: DataFrame, min_freq: int = 3, length: int = 50, order_by: list[str] | None = None, known: DataFrame | None = None) -> tuple[SampleSet, DataFrame]:
    """(set of (ids, target), vocabulary) of messages (polarity, text): ids padded on the left; neutral ones count for the vocabulary, then go.

    known: a vocabulary to use instead of a new one.
    """
    d = with_row_index(messages, order_by or ["text"], "row")
    words = vocab.exploded(d, ["row", "polarity"], "text", " +")
    v = known if known is not None else vocab.vocabulary(vocab.frequency(words), min_freq, oov="first")
    ids = vocab.sequences(vocab.encode(words, v), ["row", "polarity"])
    out = ids.select("row", vocab.padded("ids", length).alias("ids"), vocab.polarity("polarity").alias("target")).filter("target is not null")
    return SampleSet.of(out, ["row"], ["ids"], ["target"], about={"vocabulary": v}), v


def message_statistics(messages: DataFrame, v: DataFrame, min_freq: int) -> DataFrame:
    """One row: n_messages, n_tokens, vocabulary, oov_tokens."""
    words = vocab.exploded(messages, [], "text", " +")
    f = vocab.frequency(words)
    a = f.agg(F.sum("freq").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("freq") < min_freq, F.col("freq"))), F.lit(0)).alias("oov_tokens"))
    return messages.agg(F.count("*").alias("n_messages")).crossJoin(a).crossJoin(v.agg(F.count("*").alias("vocabulary")))


def write_tokenized(messages: DataFrame, path: str, text: str = "text") -> None:
    """CSV with all fields quoted; the text is its tokens, joined by blanks."""
    messages.withColumn(text, F.array_join(tweets.tokenize(text), " ")).write.mode("overwrite").option("quoteAll", True).csv(path)


def image_set(parts: list[DataFrame], valid_ratio: float = 1 / 6, scale: tuple[float, float] | None = (0.0, 1.0), order_by: list[str] | None = None, shape: tuple[int, ...] = (), classes: list[str] | None = None) -> tuple[SampleSet, SampleSet]:
    """(train, valid) of parts (id, pixels, label from 0): one union, rescaled to `scale`, labels from 1, the last share for validation."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    if scale is not None:
        low, high = numeric.value_range(d, "pixels")
        d = d.withColumn("pixels", numeric.rescale("pixels", *scale, low, high))
    d = d.withColumn("label", F.col("label").cast("long") + 1)
    return SampleSet.of(d, order_by or ["id"], ["pixels"], ["label"], shape={"pixels": shape} if shape else {}, about={"classes": classes}).cut(1 - valid_ratio)


def unpack(archive: str, target: str, exists: str | None = None) -> str:
    """Unpacks .zip, .tar, .tar.gz, .tgz or .gz, by the end of its name, unless `exists` is in the target."""
    if exists and (Path(target) / exists).exists():
        return target
    os.makedirs(target, exist_ok=True)
    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            z.extractall(target)
    elif archive.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(archive) as t:
            t.extractall(target, filter="data")
    elif archive.endswith(".gz"):
        with gzip.open(archive) as f, open(Path(target) / Path(archive).name[:-3], "wb") as out:
            shutil.copyfileobj(f, out)
    else:
        raise ValueError(f"{archive} is no archive that is known")
    return target


def fetch(source: str, target: str, exists: str | None = None) -> str:
    """Copies a local file into the target folder unless it is there; there is no download."""
    if "://" in source and not source.startswith("file://"):
        raise ValueError("only local files can be fetched")
    source = source.removeprefix("file://")
    os.makedirs(target, exist_ok=True)
    to = Path(target) / (exists or Path(source).name)
    if not to.exists():
        shutil.copy(source, to)
    return str(to)


_made = iter(range(1 << 62))


def unique_id(space: str | None = None, separator: str = ":") -> str:
    """`space:time:counter`; the host's name is the default space."""
    return separator.join((space or socket.gethostname(), str(int(time.time())), str(next(_made))))


def run_in(folder: str, f: Callable[[], object]) -> object:
    with chdir(folder):
        return f()


def run_name() -> str:
    return uuid.uuid4().hex
