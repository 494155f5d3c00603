"""Operator 8: a quality classifier by Naive Bayes support vectors.

n-gram indicators are scaled by the log-count ratio of the two classes
(r = log of smoothed class frequencies, from the labelled sample), and a linear
hinge-loss model on them is fitted by dual coordinate descent.

Cases: documents without a label only get scored; a null text scores as an empty
one, by the bias; repeated rows and null doc_ids have rows of their own; where a
doc_id has several labels the least counts; with no labelled row, or one class
only, every document is kept at score +-1 (that class, or good); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import linear

KINDS = "Rub"  # words and runs of punctuation as they are, and their bigrams

def log_count_ratio(ptr: np.ndarray, slot: np.ndarray, y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """r[slot] = log((p / |p|) / (q / |q|)) with p, q the smoothed counts of the classes y > 0 and y < 0."""
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    p = alpha + np.bincount(slot[y[row] > 0], minlength=size)
    q = alpha + np.bincount(slot[y[row] < 0], minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(ptr: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, c: np.ndarray, epochs: int = 12, tolerance: float = 0.01, seed: int = 3) -> np.ndarray:
    """w of min |w|^2 / 2 + sum_i c_i max(0, 1 - y_i w.x_i), by coordinate descent on the dual; the last slot is a bias of 1."""
    w, a = np.zeros(size + 1), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    norm = np.array([float((value[ptr[i] : ptr[i + 1]] ** 2).sum()) for i in range(len(y))]) + 1.0
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            s, v = slot[ptr[i] : ptr[i + 1]], value[ptr[i] : ptr[i + 1]]
            g = y[i] * (float(v @ w[s]) + w[size]) - 1
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == c[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(a[i] - g / norm[i], 0.0), c[i])
                step = (new - a[i]) * y[i]
                w[s] += step * v
                w[size] += step
                a[i] = new
        if worst < tolerance:
            break
    return w


def fit(texts: pa.ChunkedArray, y: np.ndarray, bits: int = linear.BITS, c: float = 1.0) -> linear.Model:
    """y > 0 good, else bad. Classes weigh the same; rows are scaled to 1 / sqrt(number of indicators)."""
    size = 1 << bits
    y = np.where(y > 0, 1.0, -1.0)
    if len(y) == 0 or len(set(y)) == 1:
        return linear.Model(np.zeros((size, 1)), np.array([y[0] if len(y) else 1.0]), KINDS)
    ptr, slot = linear.matrix(texts, bits, KINDS)
    slot = slot.astype(np.int64)  # rows are picked by it again and again
    r = log_count_ratio(ptr, slot, y, size)
    scale = 1 / np.sqrt(np.maximum(np.diff(ptr), 1))
    value = r[slot] * np.repeat(scale, np.diff(ptr))
    per = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    w = dual_descent(ptr, slot, value, y, size, per)
    return linear.Model((r * w[:size])[:, None], w[size:], KINDS)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): the least label of each doc_id."""
    return labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias("y"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = linear.FIT_ROWS, c: float = 1.0) -> DataFrame:
    """(doc_id, score, keep) for each row of docs; `fit_rows` bounds the labelled sample of the fit."""
    got = linear.sample(docs, labelled(labels, "quality"), fit_rows)
    model = fit(got.column("text"), got.column("y").to_numpy(), c=c)
    return linear.score(docs.select("doc_id", "text"), model, ["score"], "doc_id").withColumn("keep", F.col("score") > 0)
