"""Hashed text features and linear classifiers, shared by the classifying operators.

Features are indicators of words, bigrams and word beginnings, hashed into
2**bits slots. Extraction and scoring run on the workers over whole texts;
fitting runs on the driver over a sample of labelled rows whose number and bytes
are parameters, so what the driver holds is bounded whatever the table's size.
A chosen model has only features whose classes differ beyond chance, so a text of
many rare words isn't judged by their noise, and scoring looks up few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import words as tw

FIT_ROWS, FIT_BYTES = 6000, 1 << 26
BITS, WIDE_BITS = 18, 22
SIGNIFICANT = 16.0  # of the likelihood ratio statistic
BEGINNINGS = (4, 5, 6, 7)  # bytes


def tokens(part: pa.Array, kinds: str) -> tw.Words:
    """Words as they are, with punctuation, if kinds has `R`; else lower-cased words."""
    return tw.words(part, lower=False, inside=tw.PUNCTUATED) if "R" in kinds else tw.words(part)


def each(w: tw.Words, kinds: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, 64-bit id) of the words (`u`), bigrams (`b`), and beginnings of longer words (`p`) of a slice, kind by kind."""
    if "u" in kinds:
        yield np.arange(len(w.hash)), w.hash
    if "b" in kinds and len(w.doc) > 1:
        same = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        yield same, tw.combine(w.hash[same], w.hash[same + 1])
    if "p" in kinds:
        length = w.end - w.start
        long = np.flatnonzero(length > BEGINNINGS[0])
        h, at = np.zeros(len(long), np.uint64), 0
        for k in BEGINNINGS:
            more = length[long] > k
            long, h = long[more], h[more]
            with np.errstate(over="ignore"):
                for i in range(at, k):
                    h = h * np.uint64(0x100000001B3) + w.data[w.start[long] + i] + np.uint64(1)
            at = k
            yield long, tw.mix(h)


def ids(w: tw.Words, kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """(document, id) for all of each()."""
    got = list(each(w, kinds))
    return np.concatenate([w.doc[at] for at, _ in got]), np.concatenate([h for _, h in got])


def features(w: tw.Words, bits: int, kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs of a slice, sorted."""
    doc, h = ids(w, kinds)
    key = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def sums(docs: int, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of values by document."""
    return np.stack([np.bincount(doc, values[:, k], docs) for k in range(values.shape[1])], axis=1)


class Model:
    """score_k(document) = bias_k + sum of weight[slot, k] over its slots / sqrt(number of slots)."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray, kinds: str) -> None:
        self.weight, self.bias, self.kinds = weight.astype(np.float32), bias, kinds
        self.bits = int(len(weight)).bit_length() - 1

    def scores(self, w: tw.Words) -> np.ndarray:
        doc, slot = features(w, self.bits, self.kinds)
        n = np.bincount(doc, minlength=w.docs)
        return sums(w.docs, doc, self.weight[slot]) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias


class Chosen:
    """score_k(document) = bias_k + sum of weight[i, k] over the chosen features i that it has / root of their number + extra . beside_k."""

    def __init__(self, slots: np.ndarray, weight: np.ndarray, bias: np.ndarray, kinds: str, beside: np.ndarray | None = None) -> None:
        self.slots, self.weight, self.bias, self.kinds, self.beside = slots, weight.astype(np.float32), bias, kinds, beside
        self._at: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_at": None}

    def found(self, w: tw.Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index of a chosen feature) pairs of a slice, sorted."""
        if self._at is None:
            self._at = np.zeros(1 << WIDE_BITS, np.int32)
            self._at[self.slots] = np.arange(1, len(self.slots) + 1)
        keys, n = [np.zeros(0, np.int64)], len(self.slots) + 1
        for at, h in each(w, self.kinds):
            i = self._at[(h >> np.uint64(64 - WIDE_BITS)).astype(np.int64)]
            hit = np.flatnonzero(i)
            keys.append(w.doc[at[hit]] * n + i[hit])
        key = np.unique(np.concatenate(keys))
        return key // n, key % n - 1

    def scores(self, w: tw.Words, extra: np.ndarray | None = None) -> np.ndarray:
        doc, i = self.found(w)
        n = np.bincount(doc, minlength=w.docs)
        s = sums(w.docs, doc, self.weight[i]) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        return s if self.beside is None else s + extra @ self.beside


def ratios(count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, log ratio) of features in each class against the rest: count is (classes, features) of documents, size (classes)."""
    total, n = count.sum(0), size.sum()
    g, r = np.zeros(count.shape), np.zeros(count.shape)
    some = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)
    for k, (a, in_class) in enumerate(zip(count.astype(float), size.astype(float))):
        b, rest = total - a, n - in_class
        e, f = total * in_class / n, total * rest / n
        g[k] = 2 * (some(a, e) + some(b, f) + some(in_class - a, in_class - e) + some(rest - b, rest - f))
        r[k] = np.log((a + 1) / (in_class + 2)) - np.log((b + 1) / (rest + 2))
    return g, r


def fit_chosen(texts: pa.ChunkedArray, target: np.ndarray, kinds: str, extra: np.ndarray | None = None, times: np.ndarray | None = None, least: int = 3, significant: float = SIGNIFICANT) -> Chosen:
    """Multinomial logistic regression on soft targets over the features that occur in `least` documents and differ between classes by `significant`.

    Indicators are scaled by the feature's greatest log-count ratio, as in naive
    Bayes support vectors. extra: more indicators (rows, any number), taken as they are.
    times: how often each row counts.
    """
    ptr, slot = matrix(texts, WIDE_BITS, kinds)
    n, k = target.shape
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
    use = (np.bincount(slot, minlength=1 << WIDE_BITS) >= least)[slot]
    slot, row = slot[use], row[use]
    known, slot = np.unique(slot, return_inverse=True)
    count = np.stack([np.bincount(slot, target[row, c], len(known)) for c in range(k)])
    g, r = ratios(count, target.sum(0)) if n else (np.zeros((k, 0)), np.zeros((k, 0)))
    good = g.max(0) > significant
    scale = np.abs(r).max(0)[good]
    use = good[slot]
    slot, row = (np.cumsum(good) - 1)[slot[use]], row[use]
    value = scale[slot] / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    m, size = 0 if extra is None else extra.shape[1], len(scale)
    if m:
        i, j = np.nonzero(extra)
        row, slot, value = np.append(row, i), np.append(slot, size + j), np.append(value, extra[i, j])
        o = np.argsort(row, kind="stable")
        row, slot, value = row[o], slot[o], value[o]
    model = fit_softmax(np.searchsorted(row, np.arange(n + 1)), slot.astype(np.int32), target, int(size + m).bit_length(), kinds, steps=120, rate=0.1, decay=1e-4, value=value, times=times)
    return Chosen(known[good].astype(np.int64), model.weight[:size] * scale[:, None], model.bias, kinds, model.weight[size : size + m].astype(float) if m else None)


def score(docs: DataFrame, model: Model, names: list[str], keep: str) -> DataFrame:
    """(keep, a DOUBLE column of scores for each name) for each row of docs (keep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in tw.slices(b.column("text")):
                s = model.scores(tokens(part, model.kinds))
                yield pa.RecordBatch.from_arrays([b.column(keep).slice(at, len(part)), *(pa.array(s[:, k]) for k in range(s.shape[1]))], [keep, *names])

    schema = StructType([StructField(keep, docs.schema[keep].dataType), *(StructField(n, DoubleType()) for n in names)])
    return docs.select(keep, "text").mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 7, most_bytes: int = FIT_BYTES) -> pa.Table:
    """(text, y) of at most `rows` labelled rows of docs, and of at most `most_bytes` of text, least hash first.

    labels is (doc_id, y), one row a doc_id. Which rows are taken is settled on ids
    and hashes alone, so no text moves but those of the sample. The hash is of
    (doc_id, text): rows that are alike in both tie, and as many of them are taken
    as there is room for.
    """
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), F.octet_length("text").alias("n"))
    chosen = d.select("doc_id").distinct().join(labels, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    got = d.join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    first = got.select("h", "n").orderBy("h").limit(rows).toArrow()  # of one doc_id there may be any number of rows
    fits = int((np.cumsum(first.column("n").to_numpy()) <= most_bytes).sum())
    if not fits:
        return got.select("text", "y").limit(0).toArrow()
    last = int(first.column("h").to_numpy()[fits - 1])
    return got.filter(F.col("h") <= last).orderBy("h").limit(fits).select("text", "y").toArrow()


def matrix(texts: pa.ChunkedArray, bits: int, kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of indicators as (row pointers, slots)."""
    docs, slots, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for _, part in tw.slices(texts):
        d, s = features(tokens(part, kinds), bits, kinds)
        docs.append((d + base).astype(np.int32))
        slots.append(s.astype(np.int32))
        base += len(part)
    return np.searchsorted(np.concatenate(docs), np.arange(base + 1)), np.concatenate(slots)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(ptr: np.ndarray, slot: np.ndarray, target: np.ndarray, bits: int, kinds: str, steps: int = 80, rate: float = 0.3, decay: float = 2e-6, value: np.ndarray | None = None, times: np.ndarray | None = None) -> Model:
    """Multinomial logistic regression on soft targets (rows of probabilities), by Adam on the whole sample.

    value: of each indicator; by default 1 / sqrt(number of the row's indicators). times: how often each row counts.
    """
    n, k = target.shape
    times = np.ones(n) if times is None else times / times.mean()
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
    if value is None:
        value = (1 / np.sqrt(np.maximum(np.diff(ptr), 1)))[row]
    value = value.astype(np.float32)
    used = np.unique(slot)
    slot = np.searchsorted(used, slot)
    # sums by row and by slot go over sorted runs
    full = np.flatnonzero(np.diff(ptr))
    by_row = ptr[:-1][full]
    order = np.argsort(slot, kind="stable")
    by_slot = np.cumsum(np.append(0, np.bincount(slot, minlength=len(used))))[:-1]
    row_of, value_of = row[order].astype(np.int64), value[order]
    del order, row
    prior = np.log(np.maximum(times @ target / n, 1e-6)) if n else np.zeros(k)
    w = np.zeros((k, len(used) + 1), np.float32)  # a class a row, so that all passes are over contiguous numbers
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if len(slot) else 1):
        z = np.tile(w[:, -1] + prior, (n, 1))
        for c in range(k):
            z[full, c] += np.add.reduceat(w[c][slot] * value, by_row)
        e = ((softmax(z) - target) * (times / n)[:, None]).astype(np.float32).T.copy()
        g = decay * w
        for c in range(k):
            g[c, :-1] += np.add.reduceat(e[c][row_of] * value_of, by_slot)
        g[:, -1] += e.sum(axis=1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
    weight = np.zeros((1 << bits, k))
    weight[used] = w[:, :-1].T
    return Model(weight, w[:, -1] + prior, kinds)
