"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .durable import durable


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges (i, j): the least node of each node's component."""
    lab = np.arange(n)
    while len(i):
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a BIGINT, b BIGINT); component is its least node.

    Alternates large-star and small-star rounds, each one shuffle with a window,
    so no row ever holds a node's whole neighbourhood; a hub only makes a longer
    window run. Every round is checkpointed. Self-loops, repeated edges and both
    orientations are allowed; rows with a null end are passed over.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        w = Window.partitionBy("a")
        small = large.select("a", "b", F.min("b").over(w).alias("m"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = durable(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not converge")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
