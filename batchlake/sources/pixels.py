"""Image files as arrays: decoding, scaling, and the sample functions for images and frame pairs.

Files are decoded by Spark's image source on the executors; scaling and cropping of
images that differ in size run on Arrow batches. Draws come from a seed and a key,
so a sample is the same on every run and rows with one key share their draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.draws import uniform

Size = tuple[int, int, int]  # channels, height, width
PIXELS = "channels int, height int, width int, pixels array<float>"


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, height, width, pixels) of all images below path; pixels in 0..1, channel, row, column order, colours as red, green, blue."""
    d = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path)
    d = d.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), F.col("image.nChannels").alias("channels"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, h, w, data in zip(*(b.column(k).to_pylist() for k in ("channels", "height", "width", "data"))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, [2, 1, 0][:c] if c < 4 else [2, 1, 0]]
                out.append((x.transpose(2, 0, 1).astype(np.float32) / 255).ravel())
            channels = pa.array([min(c, 3) for c in b.column("channels").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("path"), channels, b.column("height"), b.column("width"), pa.array(out, pa.list_(pa.float32()))], ["path", "channels", "height", "width", "pixels"])

    return d.mapInArrow(run, f"path string, {PIXELS}")


def scaled(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """A (channels, rows, columns) image at another size, bilinear between pixel centers."""
    if x.shape[1:] == (height, width):
        return x

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(p).astype(int)
        return lo, np.minimum(lo + 1, n - 1), (p - lo).astype(np.float32)

    y0, y1, fy = at(x.shape[1], height)
    x0, x1, fx = at(x.shape[2], width)
    rows = x[:, y0] * (1 - fy)[:, None] + x[:, y1] * fy[:, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def as_channels(x: np.ndarray, channels: int) -> np.ndarray:
    """One channel as the mean of colours, or three from one."""
    if len(x) == channels:
        return x
    return x.mean(axis=0, keepdims=True) if channels == 1 else np.repeat(x[:1], channels, axis=0)


def to_smallest_side(x: np.ndarray, side: int) -> np.ndarray:
    h, w = x.shape[1:]
    return scaled(x, max(side, round(h * side / min(h, w))), max(side, round(w * side / min(h, w))))


def _crop(x: np.ndarray, top: int, left: int, h: int, w: int, flip: bool = False) -> np.ndarray:
    y = x[:, top : top + h, left : left + w]
    return y[:, :, ::-1] if flip else y


def sample_default(x: np.ndarray, load: Size, size: Size, u: np.ndarray) -> list[np.ndarray]:
    """The whole image at the sample size."""
    return [scaled(as_channels(x, size[0]), *size[1:])]


def sample_train(x: np.ndarray, load: Size, size: Size, u: np.ndarray) -> list[np.ndarray]:
    """A random crop of the loaded image, mirrored in half of the draws."""
    x = to_smallest_side(as_channels(x, size[0]), min(load[1:]))
    dh, dw = x.shape[1] - size[1], x.shape[2] - size[2]
    return [_crop(x, int(u[0] * (dh + 1)), int(u[1] * (dw + 1)), *size[1:], bool(u[2] < 0.5))]


def sample_test(x: np.ndarray, load: Size, size: Size, u: np.ndarray) -> list[np.ndarray]:
    """Center and corners of the loaded image, each followed by its mirror image: ten views."""
    x = to_smallest_side(as_channels(x, size[0]), min(load[1:]))
    dh, dw = x.shape[1] - size[1], x.shape[2] - size[2]
    places = [(-(-dh // 2), -(-dw // 2)), (0, 0), (0, dw), (dh, 0), (dh, dw)]
    return [_crop(x, t, left, *size[1:], flip) for t, left in places for flip in (False, True)]


def samples(images: DataFrame, sampler: Callable[[np.ndarray, Size, Size, np.ndarray], list[np.ndarray]], load: Size, size: Size, seed: str = "s", key: str = "path") -> DataFrame:
    """images (path, ..., pixels) with pixels at `size` and `view` (from 0): one row for each image that the sampler makes of one.

    A sampler is any function (image, load size, sample size, three uniform numbers) -> images.
    """
    rest = [c for c in images.columns if c not in ("channels", "height", "width", "pixels")]
    u = F.array(*(uniform(seed, F.concat(F.lit(f"{k}/"), F.col(key).cast("string"))) for k in range(3)))
    d = images.select(*rest, "channels", "height", "width", "pixels", u.alias("__u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, views, out = [], [], []
            shape = zip(*(b.column(k).to_pylist() for k in ("channels", "height", "width")))
            for i, (s, p, u) in enumerate(zip(shape, b.column("pixels"), b.column("__u").to_pylist())):
                x = np.asarray(p.values, np.float32).reshape(s)
                for v, y in enumerate(sampler(x, load, size, np.array(u))):
                    rows.append(i)
                    views.append(v)
                    out.append(np.ascontiguousarray(y, np.float32).ravel())
            t = pa.Table.from_batches([b]).select(rest).take(pa.array(rows, pa.int64())).combine_chunks()
            cols = [t.column(c).combine_chunks() for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(views, pa.int32()), pa.array(out, pa.list_(pa.float32()))], [*rest, "view", "pixels"])

    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in rest)
    return d.mapInArrow(run, f"{kinds}, view int, pixels array<float>")


def frame_samples(frames: DataFrame, load: Size, target_load: Size, size: Size, target_size: Size, seed: str = "s", train: bool = True, vary_load: bool = False, scale_every_step: bool = False, crop_every_step: bool = False) -> DataFrame:
    """(seq, t, input, target) pixels of frames (seq, t, input, target), both structs (channels, height, width, pixels).

    Input and target of a step share their draw. In training one relative crop (and
    with vary_load one load size between sample and load size) serves a whole
    sequence, or each step if asked for; there is no mirroring. Else both are scaled to their sample sizes.
    """
    step = F.concat_ws("/", "seq", "t")

    def key(every: bool) -> Column:
        return step if every else F.col("seq").cast("string")

    u = F.array(uniform(f"{seed}t", key(crop_every_step)), uniform(f"{seed}l", key(crop_every_step)), uniform(f"{seed}z", key(scale_every_step)))
    d = frames.select("seq", "t", "input", "target", u.alias("u"))

    def one(image: dict, load: Size, size: Size, u: list[float]) -> np.ndarray:
        x = as_channels(np.array(image["pixels"], np.float32).reshape(image["channels"], image["height"], image["width"]), size[0])
        if not train:
            return scaled(x, *size[1:])
        low, high = max(size[1:]), min(load[1:])
        side = round(low + u[2] * (high - low)) if vary_load else high
        x = to_smallest_side(x, side)
        dh, dw = x.shape[1] - size[1], x.shape[2] - size[2]
        return _crop(x, int(u[0] * (dh + 1)), int(u[1] * (dw + 1)), *size[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(["input", "target", "u"]).to_pylist()
            ins = [np.ascontiguousarray(one(r["input"], load, size, r["u"])).ravel() for r in rows]
            outs = [np.ascontiguousarray(one(r["target"], target_load, target_size, r["u"])).ravel() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("t"), pa.array(ins, pa.list_(pa.float32())), pa.array(outs, pa.list_(pa.float32()))], ["seq", "t", "input", "target"])

    return d.mapInArrow(run, "seq long, t long, input array<float>, target array<float>")
