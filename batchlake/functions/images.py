"""Crops and flips of images kept as flat arrays in channel, row, column order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .draws import uniform

Shape = tuple[int, int, int]  # channels, height, width


def crop(image: str, shape: Shape, top: Column | int, left: Column | int, size: tuple[int, int], flip: Column | bool = False) -> Column:
    """The size = (height, width) window at (top, left), mirrored if flip."""
    channels, height, width = shape
    h, w = size
    top, left = (F.lit(x) if isinstance(x, int) else x for x in (top, left))
    flipped = F.lit(flip) if isinstance(flip, bool) else flip

    def at(k: Column) -> Column:
        c, y, x = F.floor(k / (h * w)), F.floor(k % (h * w) / w), k % w
        x = F.when(flipped, w - 1 - x).otherwise(x)
        return F.get(image, (c * (height * width) + (top + y) * width + left + x).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * h * w - 1)), at)


def center(shape: Shape, size: tuple[int, int]) -> tuple[int, int]:
    return math.ceil((shape[1] - size[0]) / 2), math.ceil((shape[2] - size[1]) / 2)


def flip_horizontal(image: str, shape: Shape) -> Column:
    return crop(image, shape, 0, 0, shape[1:], True)


def random_crop(df: DataFrame, image: str, shape: Shape, size: tuple[int, int], key: str, seed: str, flip: bool = True, compat: bool = False) -> DataFrame:
    """A crop drawn by (seed, key), mirrored in half of the draws: rows of one key share it. compat never takes offset 0."""
    dh, dw = shape[1] - size[0], shape[2] - size[1]
    key_of = lambda tag: F.concat(F.lit(tag), F.col(key).cast("string"))

    def offset(tag: str, d: int) -> Column:
        u = uniform(seed, key_of(tag))
        return (F.ceil(u * d) if compat else F.floor(u * (d + 1))).cast("int")

    mirrored = uniform(seed, key_of("f")) < 0.5 if flip else F.lit(False)
    return df.withColumn(image, crop(image, shape, offset("t", dh), offset("l", dw), size, mirrored))


def ten_crop(df: DataFrame, image: str, shape: Shape, size: tuple[int, int], name: str = "view") -> DataFrame:
    """Ten rows an image: center, top left, top right, bottom left and bottom right, each followed by its mirror image."""
    dh, dw = shape[1] - size[0], shape[2] - size[1]
    corners = [center(shape, size), (0, 0), (0, dw), (dh, 0), (dh, dw)]
    views = F.array(*(F.struct(F.lit(2 * k + m).alias("v"), F.lit(t).alias("t"), F.lit(left).alias("l"), F.lit(bool(m)).alias("m")) for k, (t, left) in enumerate(corners) for m in (0, 1)))
    d = df.withColumn("__v", F.explode(views))
    return d.withColumns({image: crop(image, shape, F.col("__v.t"), F.col("__v.l"), size, F.col("__v.m")), name: F.col("__v.v")}).drop("__v")


def resize_nearest(image: str, shape: Shape, size: tuple[int, int]) -> Column:
    """The image at another size, by the nearest pixel."""
    channels, height, width = shape
    h, w = size

    def at(k: Column) -> Column:
        c, y, x = F.floor(k / (h * w)), F.floor(F.floor(k % (h * w) / w) * height / h), F.floor(k % w * width / w)
        return F.get(image, (c * (height * width) + y * width + x).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * h * w - 1)), at)


def target_size(load: tuple[int, int], target_load: tuple[int, int], sample: tuple[int, int]) -> tuple[int, int]:
    """Sample size (height, width) of targets: their load size by the inputs' ratio, rounded, from 1 to the load size."""
    h, w = (min(max(math.floor(t * s / n + 0.5), 1), t) for t, s, n in zip(target_load, sample, load))
    return h, w


def smallest_side(shape: tuple[int, int], side: int) -> tuple[int, int]:
    """(height, width) scaled so that the lesser one is `side`."""
    scale = side / min(shape)
    return max(1, round(shape[0] * scale)), max(1, round(shape[1] * scale))
