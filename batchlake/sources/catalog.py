"""Folders of classes and of frame sequences as tables, and draws balanced by class."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.draws import draw
from ..operators.rowindex import with_row_index

EXTENSIONS = ("jpg", "png", "jpeg", "ppm", "bmp")


def first_digits(name: Column | str) -> Column:
    """Sort key by the first number in a name."""
    return F.regexp_extract(name, "[0-9]+", 0).cast("int")


def class_table(facts: DataFrame, column: str, sort_key: Column | None = None) -> DataFrame:
    """(class_name, class_id, n, before): distinct classes numbered from 1 in their order, with sizes and the rows of those before."""
    c = facts.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("class_name")).agg(F.count("*").alias("n"))
    c = c.withColumn("__key", F.col("class_name") if sort_key is None else sort_key)
    w = Window.orderBy("__key", "class_name")  # one row a class
    return c.select("class_name", F.row_number().over(w).cast("long").alias("class_id"), "n", (F.sum("n").over(w) - F.col("n")).cast("long").alias("before"))


def with_ordinals(facts: DataFrame, classes: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """facts with class_id, ordinal (from 1 in the class) and _idx (class by class)."""
    d = facts.join(classes.select(F.col("class_name").alias(column), "class_id", "before"), column)
    d = d.withColumn("ordinal", F.row_number().over(Window.partitionBy("class_id").orderBy(*order_by)).cast("long"))
    return d.withColumn("_idx", F.col("before") + F.col("ordinal")).drop("before")


def balanced_draw(ordered: DataFrame, classes: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows with replacement: a class at random, then one of its rows; `pos` is the draw, from 1."""
    spark = ordered.sparkSession
    count = classes.agg(F.count("*").alias("__c"))
    d = spark.range(1, n + 1).select(F.col("id").alias("pos")).crossJoin(F.broadcast(count))  # one row
    d = d.select("pos", (draw(f"{seed}c", "pos") % F.col("__c") + 1).alias("class_id"))
    d = d.join(classes.select("class_id", "n"), "class_id")
    d = d.select("pos", "class_id", (draw(f"{seed}m", "pos") % F.col("n") + 1).alias("ordinal"))
    return d.join(ordered, ["class_id", "ordinal"])


def _glob(pattern: str, ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + "^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + "$"


def keep_files(paths: DataFrame, exclude_file: str = "", exclude_dir: str = "") -> DataFrame:
    """Rows of (path) with an image's extension whose name and full path don't match the globs."""
    p = F.col("path")
    ok = F.lower(p).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")
    if exclude_file:
        ok = ok & ~F.element_at(F.split(p, "/"), -1).rlike(_glob(exclude_file, True))
    if exclude_dir:
        ok = ok & ~p.rlike(_glob(exclude_dir, False))
    return paths.filter(ok)


def image_folders(spark: SparkSession, roots: list[str], exclude_file: str = "", exclude_dir: str = "", content: bool = True, sort_by_number: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, classes) of folders `<root>/<class>/.../<file>`; hidden folders are no classes.

    Several roots are one set. Without content only the listing is read. A class
    without an image, or no image at all, is an error.
    """
    d = None
    for root in roots:
        base = re.escape(root.rstrip("/"))
        x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        x = x.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), *(["content"] if content else []))
        x = x.withColumn("class_name", F.regexp_extract("path", f"{base}/([^/]+)/", 1)).filter((F.col("class_name") != "") & ~F.col("class_name").startswith("."))
        d = x if d is None else d.unionByName(x)
    if d is None:
        raise ValueError("no folder is given")
    found = d.select("class_name").distinct()
    kept = keep_files(d, exclude_file, exclude_dir)
    classes = class_table(kept, "class_name", first_digits("class_name") if sort_by_number else None)
    empty = [r[0] for r in found.join(classes, "class_name", "left_anti").limit(5).collect()]
    if empty:
        raise ValueError(f"classes without an image: {empty}")
    if classes.isEmpty():
        raise ValueError("no image is found")
    return with_ordinals(kept, classes, "class_name", ["path"]), classes


def frame_sequences(paths: DataFrame, input_pattern: str = r"input(\d+)\.", target_pattern: str = r"target(\d+)\.") -> tuple[DataFrame, DataFrame]:
    """(frames, index) of paths `.../<seq>/input<t>.<ext>` and `target<t>`: frames (seq, t, input, target), index (seq, name, frames).

    Frames count from 1 without a gap; those after a gap are left out.
    """
    d = paths.select("path", F.element_at(F.split("path", "/"), -2).alias("name"))
    t_of = lambda p: F.regexp_extract("path", p, 1)
    d = d.withColumns({"role": F.when(t_of(input_pattern) != "", "input").when(t_of(target_pattern) != "", "target"), "t": F.coalesce(F.when(t_of(input_pattern) != "", t_of(input_pattern)).otherwise(F.when(t_of(target_pattern) != "", t_of(target_pattern))), F.lit(None)).cast("long")})
    pair = d.filter("role is not null").groupBy("name", "t").agg(F.max(F.when(F.col("role") == "input", F.col("path"))).alias("input"), F.max(F.when(F.col("role") == "target", F.col("path"))).alias("target"))
    pair = pair.filter("input is not null").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("t"))).filter("r = t").drop("r")
    index = with_row_index(pair.groupBy("name").agg(F.count("*").alias("frames")), ["name"], "seq", parts=1)
    return pair.join(index.select("name", "seq"), "name").select("seq", "t", "input", "target"), index


def positional_join(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Row i of left beside row i of right, each in its order; further rows of the longer side are left out."""
    return with_row_index(left, left_order).join(with_row_index(right, right_order), "_idx")


def rename_plan(names: DataFrame, classes: DataFrame, key: str, new: str) -> DataFrame:
    """(src, dst) for names (src, key) whose key is known; nothing is moved."""
    return names.join(classes, key).select("src", F.col(new).cast("string").alias("dst"))
