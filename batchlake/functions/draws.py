"""Seeded draws that depend on (seed, counter) only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(seed: str, counter: Column | str) -> Column:
    """A number in [0, 2**32) from the first 8 hex digits of md5(`seed:counter`)."""
    c = F.col(counter) if isinstance(counter, str) else counter
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 8), 16, 10).cast("long")


def uniform(seed: str, counter: Column | str) -> Column:
    """A double in [0, 1)."""
    return draw(seed, counter) / F.lit(4294967296.0)
