import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlake.sources import pixels


def png(path, rgb):
    """Writes an 8-bit RGB PNG."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def images(tmp_path):
    rng = np.random.default_rng(0)
    made = {}
    for i, (h, w) in enumerate([(8, 8), (12, 8), (8, 16)]):
        made[i] = rng.integers(0, 256, (h, w, 3))
        png(tmp_path / f"{i}.png", made[i])
    return str(tmp_path), made


def test_decoding_and_samples(spark, images):
    path, made = images
    d = pixels.decoded(spark, path)
    rows = {int(r.path[-5]): r for r in d.collect()}
    for i, x in made.items():
        assert np.allclose(np.array(rows[i].pixels).reshape(3, *x.shape[:2]), x.transpose(2, 0, 1) / 255, atol=1e-6)
    load, size = (3, 8, 8), (3, 4, 4)
    assert all(len(r.pixels) == 48 and r.view == 0 for r in pixels.samples(d, pixels.sample_default, load, size).collect())
    ten = pixels.samples(d, pixels.sample_test, load, size).collect()
    assert len(ten) == 30
    by = {(int(r.path[-5]), r.view): np.array(r.pixels).reshape(3, 4, 4) for r in ten}
    want = made[0].transpose(2, 0, 1) / 255
    assert np.allclose(by[0, 0], want[:, 2:6, 2:6], atol=1e-6) and np.allclose(by[0, 3], want[:, :4, :4][:, :, ::-1], atol=1e-6)
    a, b = (sorted(tuple(r.pixels) for r in pixels.samples(d, pixels.sample_train, load, size, s).collect()) for s in ("x", "x"))
    assert a == b and a != sorted(tuple(r.pixels) for r in pixels.samples(d, pixels.sample_train, load, size, "y").collect())
    gray = pixels.samples(d, lambda x, load, size, u: [pixels.as_channels(x, 1)[:, :2, :2]], load, (1, 2, 2)).collect()
    assert all(len(r.pixels) == 4 for r in gray)


def test_frames_share_a_crop(spark):
    x = [float(i) for i in range(64)]
    image = F.struct(F.lit(1).alias("channels"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.array(*map(F.lit, x)).cast("array<float>").alias("pixels"))
    d = spark.range(1, 4).select(F.lit(1).cast("long").alias("seq"), F.col("id").alias("t"), image.alias("input"), image.alias("target"))
    size = (1, 4, 4)
    rows = pixels.frame_samples(d, (1, 8, 8), (1, 8, 8), size, size).collect()
    assert len(rows) == 3 and len({tuple(r.input) for r in rows}) == 1 and all(r.input == r.target for r in rows)
    each = pixels.frame_samples(d, (1, 8, 8), (1, 8, 8), size, size, crop_every_step=True, vary_load=True, scale_every_step=True).collect()
    assert len({tuple(r.input) for r in each}) > 1 and all(r.input == r.target for r in each)
    whole = pixels.frame_samples(d, (1, 8, 8), (1, 8, 8), (1, 8, 8), (1, 4, 4), train=False).first()
    assert whole.input == x and len(whole.target) == 16
