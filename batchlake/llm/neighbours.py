"""Operator 4: approximate nearest neighbours by balanced posting lists.

Centroids are found by k-means over all vectors with a penalty on full clusters,
so posting lists have like lengths. A vector near the boundary of clusters is
replicated: it goes to those of its `replicas` nearest centroids that are within
`spread` times the least distance. Centroids (about `lists_per_root` times the root of
the number of vectors, but lists have at least `least_list` vectors on average) are held
by every worker and searched in a proximity graph. A query
takes every list whose centroid is within `prune` times the distance of its
nearest one (or of the mean distance of vectors from their centroids, if that is
more, as a query that lies on a centroid would else see one list only), however
many these are: the beam is widened until a list beyond the ratio is met.

All vectors are indexed; queries are those whose vec_id is divisible by `every`.
A list of more than `part_rows` postings is split by the hash of its vectors and a
probe goes to each part, so a hot list is many tasks' work. A task holds one part
of one list at a time and gives the k best of it for each query; the k best of
all are then taken by Spark's window group limit, before and after the shuffle.

Distances are Euclidean. Cases: a null vec_id, a null vector, one with a null,
NaN or infinite element, and one whose length is not that of most vectors are
passed over; repeated rows (same vec_id and vector) count once, so vectors under
one vec_id that differ are each a neighbour and a query of that vec_id, and a
query never has its own vec_id as neighbour; ties go by vec_id; fewer than k
others give fewer rows; an empty table gives none; other columns are ignored.
vec_id is an integer, or can be cast to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .durable import durable

K, LISTS_PER_ROOT, SPREAD, REPLICAS, PRUNE, ROUNDS, PART_ROWS, LEAST_LIST = 10, 2.0, 1.1, 4, 1.15, 6, 20_000, 64


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dimension) of a column of float32 in binary form."""
    if len(column) == 0:
        return np.zeros((0, 0), np.float32)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, int(off[-1] - off[0]) // 4, int(off[0])).reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    width = x.shape[1] * 4 if x.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("embedding")
        flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), np.float32)
        n = v.value_lengths().to_numpy(zero_copy_only=False)
        if len(n) and (n == n[0]).all() and n[0]:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _binary(flat.reshape(len(n), -1))], ["vec_id", "v"])


def packed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) with v in binary form, and the vectors' dimension."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    d = d.filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    d = d.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = d.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return d.select("vec_id", F.lit(None).cast("binary").alias("v")), 0
    d = d.filter(F.size("embedding") == common.n).distinct()
    return durable(d.mapInArrow(_packed, "vec_id long, v binary")), common.n


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0)


class Graph:
    """A proximity graph over centroids: each node's nearest ones and those that have it, with pivots to enter by."""

    def __init__(self, centroids: np.ndarray, degree: int = 16) -> None:
        self.c = np.ascontiguousarray(centroids, np.float32)
        n = len(self.c)
        degree = min(degree, max(n - 1, 1))
        near = np.zeros((n, degree), np.int32)
        for at in range(0, n, 1024):
            d = squared(self.c[at : at + 1024], self.c)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + len(d)] = np.argsort(d, axis=1)[:, :degree]
        back: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i, : degree // 2]:
                back[j].append(i)
        self.links = np.empty((n, degree + degree // 2), np.int32)
        for i in range(n):
            extra = (back[i] or near[i].tolist())[: degree // 2]
            row = near[i].tolist() + extra
            self.links[i] = (row * 2)[: self.links.shape[1]] if len(row) < self.links.shape[1] else row[: self.links.shape[1]]
        self.pivots = np.unique(np.linspace(0, n - 1, min(n, int(np.ceil(4 * np.sqrt(n))))).astype(np.int32))

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), both (len(q), want), nearest first: beam search until no node of the beam is left to expand, all queries of a block in step."""
        n = len(self.c)
        want = min(want, n)
        beam = min(n, max(want, 8))
        step = max(6, beam // 8)  # nodes expanded at once
        ids, ds = np.empty((len(q), want), np.int32), np.empty((len(q), want), np.float32)
        for at in range(0, len(q), 256):
            x = q[at : at + 256]
            rows = np.arange(len(x))[:, None]
            d = squared(x, self.c[self.pivots])
            take = np.argsort(d, axis=1)[:, : min(beam, len(self.pivots))]
            got, dist = self.pivots[take], np.take_along_axis(d, take, 1)
            if got.shape[1] < beam:
                got = np.pad(got, ((0, 0), (0, beam - got.shape[1])), constant_values=-1)
                dist = np.pad(dist, ((0, 0), (0, beam - dist.shape[1])), constant_values=np.inf)
            seen = np.zeros((len(x), n + 1), bool)  # the last column takes what is empty
            seen[rows, got] = True
            open_ = got >= 0
            while True:
                # the few best nodes that are not expanded yet
                order = np.argsort(np.where(open_, dist, np.inf), axis=1)[:, :step]
                chosen = np.take_along_axis(open_, order, 1)
                if not chosen.any():
                    break
                node = np.where(chosen, np.take_along_axis(got, order, 1), -1)
                np.put_along_axis(open_, order, False, 1)
                new = np.where((node >= 0)[:, :, None], self.links[np.maximum(node, 0)], -1).reshape(len(x), -1)
                new = np.sort(new, axis=1)
                fresh = (new >= 0) & ~seen[rows, new]
                fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
                r, k = np.nonzero(fresh)
                if not len(r):
                    continue
                i = new[r, k]
                seen[r, i] = True
                nd = np.full(new.shape, np.inf, np.float32)
                nd[r, k] = ((x[r] - self.c[i]) ** 2).sum(1)
                all_d = np.concatenate([dist, nd], axis=1)
                top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
                all_i = np.concatenate([got, np.where(fresh, new, -1)], axis=1)
                all_o = np.concatenate([open_, fresh], axis=1)
                dist, got, open_ = (np.take_along_axis(a, top, 1) for a in (all_d, all_i, all_o))
            order = np.argsort(dist, axis=1, kind="stable")[:, :want]
            ids[at : at + 256], ds[at : at + 256] = np.take_along_axis(got, order, 1), np.take_along_axis(dist, order, 1)
        return ids, ds


def _assign_sums(graph: Graph, penalty: np.ndarray):
    """Per partition and cluster: (list, sum of vectors, count, sum of squared distances)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim = graph.c.shape
        total, count, spread = np.zeros((n, dim)), np.zeros(n, np.int64), np.zeros(n)
        for b in batches:
            x = _vectors(b.column("v"))
            if len(x) == 0:
                continue
            ids, d = graph.search(x, 8)
            best = np.argmin(d + penalty[ids], axis=1)
            mine = ids[np.arange(len(x)), best]
            np.add.at(total, mine, x)
            count += np.bincount(mine, minlength=n)
            spread += np.bincount(mine, d[np.arange(len(x)), best], n)
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(total[k]), pa.list_(pa.float64())), pa.array(count[k]), pa.array(spread[k])], ["list", "total", "n", "spread"])

    return run


def train_centroids(p: DataFrame, dim: int, lists: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Centroids by balanced k-means over all vectors, and the mean squared distance of vectors from theirs; only sums a cluster come to the driver."""
    first = p.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(4 * lists).select("v").toArrow()
    c = _vectors(first.column("v").combine_chunks())
    c = c[np.sort(np.unique(c, axis=0, return_index=True)[1])[:lists]].copy()  # copies would begin as one cluster many times
    penalty, mean = np.zeros(len(c), np.float32), 0.0
    schema = "list long, total array<double>, n long, spread double"
    for _ in range(rounds):
        s = p.mapInArrow(_assign_sums(Graph(c), penalty), schema)
        s = s.groupBy("list").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"), F.sum("n").alias("n"), F.sum("spread").alias("spread")).toArrow()
        at, n = s.column("list").to_numpy(), s.column("n").to_numpy()
        c[at] = np.stack(s.column("total").to_numpy(zero_copy_only=False)) / n[:, None]
        size = np.zeros(len(c))
        size[at] = n
        mean = float(s.column("spread").to_numpy().sum() / max(n.sum(), 1))
        penalty = (penalty + 0.1 * mean * (size / max(size.mean(), 1) - 1)).astype(np.float32)
    return c, mean


def within(d: np.ndarray, ratio: float, least: float = 0.0) -> np.ndarray:
    """Mask of the lists whose squared distances d, nearest first, are within `ratio` times the least distance, or the root of `least` if that is more."""
    return d <= ratio * ratio * np.maximum(d[:, :1], least) + 1e-12


def probed(graph: Graph, x: np.ndarray, prune: float, least: float, want: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(query, centroid) for every centroid within the ratio; queries whose beam was too narrow are searched again with a wider one."""
    queries, lists, open_ = [], [], np.arange(len(x))
    while len(open_):
        ids, d = graph.search(x[open_], want)
        mask = within(d, prune, least)
        narrow = mask[:, -1] & (ids.shape[1] < len(graph.c))
        r, k = np.nonzero(mask & ~narrow[:, None])
        queries.append(open_[r])
        lists.append(ids[r, k])
        open_, want = open_[narrow], 2 * want
    return (np.concatenate(queries), np.concatenate(lists)) if queries else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _postings(graph: Graph, spread: float, replicas: int):
    """(list, side = 0, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x, vec = _vectors(part.column("v")), part.column("vec_id").to_numpy()
                ids, d = graph.search(x, replicas)
                r, k = np.nonzero(within(d, spread))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, k].astype(np.int64)), pa.array(np.zeros(len(r), np.int32)), pa.array(vec[r]), _binary(x[r])], ["list", "side", "vec_id", "v"])

    return run


def _probes(graph: Graph, prune: float, least: float):
    """(list, side = 1, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x, vec = _vectors(part.column("v")), part.column("vec_id").to_numpy()
                r, lists = probed(graph, x, prune, least)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), pa.array(np.ones(len(r), np.int32)), pa.array(vec[r]), _binary(x[r])], ["list", "side", "vec_id", "v"])

    return run


def _best(q: np.ndarray, qv: np.ndarray, x: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query vec_id, neighbour, distance): the k nearest of x for each query, ties by vec_id."""
    d = squared(q, x)
    d[qv[:, None] == vec] = np.inf
    m = min(k, len(x))
    last = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
    # what is as near as the last one but for rounding is measured anew
    near = np.isfinite(d) & (d <= np.where(np.isfinite(last), last + 1e-5 * (np.abs(last) + (q * q).sum(1)[:, None]), np.inf))
    r, j = np.nonzero(near)
    exact = np.empty(len(r))
    for at in range(0, len(r), 1 << 16):
        s = slice(at, at + (1 << 16))
        exact[s] = ((q[r[s]].astype(np.float64) - x[j[s]]) ** 2).sum(1)
    o = np.lexsort((vec[j], exact, r))
    r, j, exact = r[o], j[o], exact[o]
    first = np.searchsorted(r, np.arange(len(q)))
    ok = np.arange(len(r)) - first[r] < k
    return qv[r[ok]], vec[j[ok]], np.sqrt(exact[ok])


def _search(k: int):
    """Over rows sorted by (list, part, side): a part's postings are held, its queries pass by in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, joined = None, [], None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("list", "part", "side", "vec_id")]
            x = _vectors(b.column("v"))
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if s == e:
                    continue
                now = (int(cols[0][s]), int(cols[1][s]))
                if now != key:
                    key, held, joined = now, [], None
                if cols[2][s] == 0:
                    held.append((x[s:e], cols[3][s:e]))
                    continue
                if not held:
                    continue
                if joined is None:
                    joined = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                for lo in range(s, e, 256):
                    hi = min(e, lo + 256)
                    got = _best(x[lo:hi], cols[3][lo:hi], *joined, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["vec_id", "neighbour_id", "distance"])

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = 1, lists_per_root: float = LISTS_PER_ROOT, spread: float = SPREAD, replicas: int = REPLICAS, prune: float = PRUNE, part_rows: int = PART_ROWS, least_list: int = LEAST_LIST) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others of every vector (vec_id, embedding) whose vec_id is divisible by `every`."""
    schema = "vec_id long, rank long, neighbour_id long, distance double"
    p, dim = packed(vectors)
    if dim == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    n = p.count()
    lists = int(np.ceil(min(lists_per_root * np.sqrt(n), n / least_list)))
    centroids, mean = train_centroids(p, dim, lists)
    graph = Graph(centroids)
    kind = "list long, side int, vec_id long, v binary"
    postings = durable(p.mapInArrow(_postings(graph, spread, replicas), kind))
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / part_rows).alias("parts")).toArrow()  # one row a list
    parts = np.ones(len(centroids), np.int64)
    parts[sizes.column("list").to_numpy()] = sizes.column("parts").to_numpy()
    long = F.create_map(*(F.lit(int(x)) for i in np.flatnonzero(parts > 1) for x in (i, parts[i]))) if (parts > 1).any() else None
    of = F.lit(1) if long is None else F.coalesce(F.element_at(long, F.col("list").cast("int")), F.lit(1))
    rows = postings.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), of).cast("int"))
    probes = p.filter(F.col("vec_id") % every == 0).mapInArrow(_probes(graph, prune, mean), kind)
    met = rows.unionByName(probes.withColumn("part", F.explode(F.sequence(F.lit(0), (of - 1).cast("int")))))
    met = met.repartition("list", "part").sortWithinPartitions("list", "part", "side").select("list", "part", "side", "vec_id", "v")
    best = met.mapInArrow(_search(k), "vec_id long, neighbour_id long, distance double").repartition("vec_id")
    best = best.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("distance"))  # replicas meet in several lists
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")).cast("long"))
    return best.filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")
