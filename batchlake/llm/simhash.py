"""Operator 10: near-duplicate documents by SimHash and a generalised pigeonhole search.

A document's sketch has 192 bits: signs of the sums of random +-1 vectors of its
distinct lower-cased words. Two documents are near duplicates if their sketches
differ in at most `radius` of the first 64 bits and in at most `confirm` of all
192 (the wider test removes chance meetings of unrelated documents).

The search over the 64 bits is exact. Bits are grouped so that correlated ones
share a partition; the number of candidate pairs that a partition brings at each
threshold is counted exactly over all documents, from the histogram of its
values and that histogram's XOR-autocorrelation; dynamic programming then gives
each partition its own threshold, with sum(t_i + 1) = radius + 1, for the least
total work. Each document probes each partition with the ball around its value,
halved between the two sides, and every meeting is verified.

Groups are the connected components of verified pairs; the least
(doc_id, text hash) of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as tw
from .components import components, local_labels
from .durable import durable, unpacked, whole_row

BITS = 64
LANES = 24  # bytes of the whole sketch
_spread = np.zeros(256, np.uint64)
for _b in range(256):
    _spread[_b] = sum(1 << (8 * k) for k in range(8) if _b >> k & 1)


def sketch(w: tw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct words, 3 uint64 of sketch) for each document of a slice."""
    n = np.zeros(w.docs, np.int64)
    out = np.zeros((w.docs, 3), np.uint64)
    doc, h = tw.distinct(w.doc, w.hash)
    if len(doc) == 0:
        return n, out
    first, count = tw.runs(doc)
    rank = np.arange(len(doc)) - np.repeat(first, count)
    begin = np.flatnonzero(rank % 255 == 0)  # a byte counts to 255
    lanes = np.empty((len(begin), LANES), np.uint64)
    for k in range(3):
        with np.errstate(over="ignore"):
            r = tw.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        lanes[:, 8 * k : 8 * k + 8] = np.add.reduceat(_spread[np.ascontiguousarray(r).view(np.uint8).reshape(-1, 8)], begin, axis=0)
    ones = lanes.view(np.uint8).reshape(len(begin), LANES * 8).astype(np.int32)
    ones = np.add.reduceat(ones, np.searchsorted(begin, first), axis=0)
    bits = 2 * ones > count[:, None]
    n[doc[first]] = count
    out[doc[first]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1, 3)
    return n, out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, part in tw.slices(b.column("text")):
            n, s = sketch(tw.words(part))
            rest = [b.column(c).slice(at, len(part)) for c in ("doc_id", "tk")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n), *(pa.array(s[:, k].view(np.int64)) for k in range(3))], ["doc_id", "tk", "n", "f0", "f1", "f2"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, f0, f1, f2): tk is the text's hash, n its distinct words, f the sketch."""
    d = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    return d.mapInArrow(_sketches, "doc_id long, tk long, n long, f0 long, f1 long, f2 long")


def _bits(f0: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f0).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of equal size; each next bit is the one most correlated with the group.

    both[i, j]: in how many of n sketches bits i and j are both set.
    """
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(c, 0)
    left, out = list(range(len(p))), []
    while left:
        g = [max(left, key=lambda b: (c[b, left].sum(), -b))]
        left.remove(g[0])
        while len(g) < len(p) // parts:
            b = max(left, key=lambda b: (c[b, g].sum(), -b))
            g.append(b)
            left.remove(b)
        out.append(sorted(g))
    return out


def values(f0: np.ndarray, group: list[int]) -> np.ndarray:
    """The value that a group of bits has in each sketch."""
    v = np.zeros(len(f0), np.uint32)
    f = f0.view(np.uint64)
    for k, b in enumerate(group):
        v |= ((f >> np.uint64(b)) & np.uint64(1)).astype(np.uint32) << np.uint32(k)
    return v


def meetings(hist: np.ndarray) -> np.ndarray:
    """How many unordered pairs of rows have values at Hamming distance exactly 0, 1, 2, ..."""
    a = hist.astype(np.float64)
    n, h = len(a), 1
    while h < n:
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    a = a * a
    h = 1
    while h < n:
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    by = np.bincount(np.bitwise_count(np.arange(n, dtype=np.uint32)), weights=a / n)
    by[0] -= hist.sum()
    return np.maximum(by / 2, 0)


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` of `width` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint32)


def sides(t: int) -> tuple[int, int]:
    """Radii whose sum is t, for the two sides of a probe."""
    return t // 2, t - t // 2


def allocate(pairs: list[np.ndarray], widths: list[int], n: int, radius: int, probe_cost: float = 1000.0) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) >= radius + 1 and the least estimated work.

    Work of a partition: `probe_cost` for every signature written, 1 for every pair
    that then meets. By dynamic programming over partitions.
    """
    need = radius + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for i, width in enumerate(widths):
        cost = [0.0]
        for t in range(min(width, radius) + 1):
            lo, hi = sides(t)
            signatures = len(ball(width, hi)) + (len(ball(width, lo)) if lo != hi else 0) if hi <= 4 else float("inf")
            meet = float(pairs[i][: t + 1].sum()) * (1 + t)
            cost.append(signatures * n * probe_cost + meet)
        step: list[tuple[float, list[int]]] = [(float("inf"), [])] * (need + 1)
        for had, (c, ts) in enumerate(best):
            for used, more in enumerate(cost):
                to = min(need, had + used)
                if c + more < step[to][0]:
                    step[to] = (c + more, [*ts, used - 1])
        best = step
    return best[need][1]


def plan_search(nodes: DataFrame, radius: int, parts: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and thresholds, from statistics of all nodes (f0)."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            f = b.column("f0").to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 1 << 15):
                m = _bits(f[at : at + (1 << 15)]).astype(np.float32)
                total += m.T @ m
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["k", "c"])

    got = dict(nodes.select("f0").mapInArrow(both, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect())
    n = got.pop(BITS * BITS, 0)
    groups = group_bits(np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS), n, parts)

    def hist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("f0").to_numpy(zero_copy_only=False)
            for i, g in enumerate(groups):
                v, c = np.unique(values(f, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v.astype(np.int64)), pa.array(c.astype(np.int64))], ["i", "v", "c"])

    pairs = [np.zeros(1 << len(g), np.int64) for g in groups]
    found = nodes.select("f0").mapInArrow(hist, "i long, v long, c long").groupBy("i", "v").agg(F.sum("c").alias("c")).toArrow()
    i, v, c = (found.column(k).to_numpy() for k in ("i", "v", "c"))
    for k in range(len(groups)):
        pairs[k][v[i == k]] = c[i == k]
    return groups, allocate([meetings(h) for h in pairs], [len(g) for g in groups], n, radius)


def _probe(groups: list[list[int]], thresholds: list[int]):
    """Rows (key, side, node, f0, f1, f2): side 0 meets 1, side 2 meets itself."""
    plan = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            lo, hi = sides(t)
            plan += [(i, g, 2, ball(len(g), hi))] if lo == hi else [(i, g, 0, ball(len(g), lo)), (i, g, 1, ball(len(g), hi))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "f0", "f1", "f2")]
                for i, g, side, masks in plan:
                    key = ((values(cols[1], g)[:, None] ^ masks).astype(np.int64) << 4 | i).ravel() << 2 | side
                    yield pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.array(key), *(pa.array(np.repeat(c, len(masks))) for c in cols)], ["bucket", "key", "node", "f0", "f1", "f2"])

    return run


def _verify(radius: int, confirm: int):
    """In each bucket all pairs of sides that meet; of those within both radii, a spanning forest."""

    def close(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = [], []
        step = max(1, (1 << 20) // max(len(b), 1))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            x, y = np.nonzero(np.bitwise_count(f[rows, 0][:, None] ^ f[b, 0]) <= radius)
            i.append(rows[x])
            j.append(b[y])
        i, j = np.concatenate(i), np.concatenate(j)
        ok = (i != j) & (np.bitwise_count(f[i] ^ f[j]).sum(1, dtype=np.int64) <= confirm)
        return i[ok], j[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cols = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("key", "node", "f0", "f1", "f2")}
        del got
        order = np.argsort(cols["key"], kind="stable")
        key, node = cols["key"][order], cols["node"][order]
        f = np.stack([cols[c][order].view(np.uint64) for c in ("f0", "f1", "f2")], axis=1)
        at, n = tw.runs(key >> 2)
        ends_i, ends_j = [], []
        for s, m in zip(at[n > 1].tolist(), n[n > 1].tolist()):
            side = key[s : s + m] & 3
            if side[0] == 2:
                a = b = np.arange(s, s + m)
            else:
                a, b = s + np.flatnonzero(side == 0), s + np.flatnonzero(side == 1)
            if len(a) and len(b):
                i, j = close(f, a, b)
                if len(i):
                    lab = local_labels(m, i - s, j - s)
                    k = np.flatnonzero(lab != np.arange(m))
                    ends_i.append(node[s + k])
                    ends_j.append(node[s + lab[k]])
        if ends_i:
            e = np.unique(np.stack([np.concatenate(ends_i), np.concatenate(ends_j)], axis=1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, radius: int = 11, confirm: int = 38, parts: int = 4) -> DataFrame:
    """One row for every document that goes: (doc_id, tk, kept_doc_id, kept_tk, group_size).

    tk is xxhash64(text), as doc_id need not be unique. Documents whose sketches
    are equal form one node of the search, so copies cost nothing there. Cases:
    a null doc_id or text is passed over (never goes); texts without a letter or
    digit, empty ones too, are duplicates only of the very same text; a repeated
    row (same doc_id and text) is one document here; of ties the least
    (doc_id, tk) stays; an empty table gives no rows; other columns are ignored.
    doc_id is an integer, or can be cast to one.
    """
    return _removals(durable(sketches(docs)), radius, confirm, parts)


def _removals(s: DataFrame, radius: int, confirm: int, parts: int) -> DataFrame:
    s = s.distinct()
    worded = s.filter("n > 0")
    nodes = durable(worded.groupBy("f0", "f1", "f2").agg(F.min(F.xxhash64("doc_id", "tk")).alias("node")))
    groups, thresholds = plan_search(nodes, radius, parts)
    probes = nodes.mapInArrow(_probe(groups, thresholds), "bucket long, key long, node long, f0 long, f1 long, f2 long")
    edges = probes.repartition("bucket").mapInArrow(_verify(radius, confirm), "a long, b long")
    comp = components(edges)
    w = worded.join(nodes, ["f0", "f1", "f2"]).join(comp, "node", "left").select("doc_id", "tk", F.coalesce("component", "node").alias("g"), F.lit(0).alias("kind"))
    bare = s.filter("n = 0").select("doc_id", "tk", F.col("tk").alias("g"), F.lit(1).alias("kind"))
    both = w.unionAll(bare)
    keep = both.groupBy("kind", "g").agg(F.min(F.struct("doc_id", "tk")).alias("first"), F.count("*").alias("group_size")).filter("group_size > 1")
    return both.join(keep, ["kind", "g"]).filter("doc_id <> first.doc_id or tk <> first.tk").select("doc_id", "tk", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.tk").alias("kept_tk"), "group_size")


def drop_near_duplicates(docs: DataFrame, radius: int = 11, confirm: int = 38, parts: int = 4) -> DataFrame:
    """`docs` without the documents that near_duplicates() names; of repeated rows of one (doc_id, text) one stays.

    Which of them stays is settled by their other columns: the row that is least as
    JSON. Rows with a null doc_id or text stay as they are. Columns are those of
    docs, whatever their names; an empty table gives no rows.
    """
    s = durable(sketches(docs))
    gone = _removals(s, radius, confirm, parts).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"))
    again = durable(s.groupBy("doc_id", "tk").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")))
    rows = docs.select(whole_row(docs).alias("__row"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__hash"), F.col("text").isNotNull().alias("__text"))
    same = F.col("__text") & (F.col("__doc") == F.col("__id")) & (F.col("__hash") == F.col("__tk"))
    if again.isEmpty():
        return unpacked(rows.join(gone, same, "left_anti"), "__row", docs.columns)
    once = rows.join(again.join(gone, ["__id", "__tk"], "left_anti"), same, "left_semi")
    once = once.groupBy("__doc", "__hash").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return unpacked(rows.join(gone.unionAll(again), same, "left_anti").select("__row").unionAll(once.select("__row")), "__row", docs.columns)
