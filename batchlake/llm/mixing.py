"""Operator 5: rates that bring a corpus to target token totals, with soft domain membership.

A classifier trained on the labelled table (a softmax over the words, bigrams and
word beginnings whose frequencies differ between domains beyond chance) gives each
document a posterior over domains. A document of n tokens and posterior p, taken at rate x, adds n x p to
the expected token totals. The rates minimise the squared distance of these
totals to their targets over x >= 0, and of the rates that do, those nearest to 1
are taken, in the metric in which a document weighs by its tokens. They are
max(1 - p . price, 0) with one price a domain, so the problem has as many unknowns
as there are domains: Newton steps on the prices, each one aggregation that tries
some step lengths at once, with a weight on the distance from 1 that is lowered
until the totals are right. They are when each domain's total is within
`tolerance` of its target (or within GRAIN / 10 of all tokens, if that is more), or, where targets are out of reach, when a dual bound
shows it to be that near to its total at the optimum, or, if the targets are missed by
far more than that, all totals together within FLOOR of the targets' norm; otherwise
solve() raises.

Cases: a null or empty text has no tokens and rate 1; without labels there is one
domain, `clean`; a domain that has less than GRAIN of all expected tokens, as one without
a label, counts as absent: its posteriors, some classifier's rounding, get no price and
its target is not looked at; repeated rows and null doc_ids are documents of
their own (of equal doc_id and text they share the draw of mix()); of several labels
of a doc_id the greatest domain counts; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import linear, words as tw
from .durable import durable, unpacked, whole_row

DOMAINS = ("clean", "low", "toxic")
#: Wanted expected tokens of each domain, as a share of what the corpus has of it.
TARGETS = {"clean": 1.25, "low": 0.25, "toxic": 0.1}
KINDS = "Rubp"
STEPS, TOLERANCE, FLOOR = 100, 1e-3, 1e-5
#: A domain with a smaller share of all expected tokens is absent.
GRAIN = 1e-6
LENGTHS = (1, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): index in DOMAINS, of several labels the greatest."""
    toxic, low = F.coalesce(F.col("toxic") > 0, F.lit(False)), F.coalesce(F.col("quality") <= 0, F.lit(False))
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    return known.groupBy("doc_id").agg(F.max(F.when(toxic, 2).when(low, 1).otherwise(0)).alias("y"))


def domain_model(docs: DataFrame, labels: DataFrame, fit_rows: int) -> linear.Chosen:
    """Softmax over DOMAINS, from at most `fit_rows` labelled rows."""
    got = linear.sample(docs, domain_labels(labels), fit_rows)
    y = got.column("y").to_numpy().astype(np.int64)
    if len(y) == 0:
        return linear.Chosen(np.zeros(0, np.int64), np.zeros((0, len(DOMAINS))), np.array([0.0, -50.0, -50.0]), KINDS)
    return linear.fit_chosen(got.column("text"), np.eye(len(DOMAINS))[y], KINDS)


POSTERIORS = [StructField("n_tokens", LongType()), *(StructField(f"p_{d}", DoubleType()) for d in DOMAINS)]


def _posteriors(model: linear.Chosen, keep: str):
    """(keep, n_tokens, p_*) of rows (keep, text), or of rows (keep) where that is a struct with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text") if "text" in b.schema.names else b.column(keep).field("text")
            for at, part in tw.slices(text):
                w = linear.tokens(part, model.kinds)
                p = linear.softmax(model.scores(w))
                begins = (w.start == w.offsets[w.doc]) | (w.data[w.start - 1] <= 32)  # else it follows on another run
                n = np.bincount(w.doc[begins], minlength=len(part))
                yield pa.RecordBatch.from_arrays([b.column(keep).slice(at, len(part)), pa.array(n), *(pa.array(p[:, k]) for k in range(p.shape[1]))], [keep, *(f.name for f in POSTERIORS)])

    return run


def replay(p: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors p at the domains' prices, and what each document is priced at."""
    worth = p @ prices
    return np.maximum(1 - worth, 0), worth


def _totals(tried: list[np.ndarray], present: np.ndarray):
    """Per partition and vector of prices: token totals, Gram matrix of the documents not at rate 0, sum of n x^2; and the least worth of a unit of posterior (`low`). Only domains that are `present` have posteriors."""
    k = len(DOMAINS)
    size = k + k * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, low = np.zeros((len(tried), size)), np.full((len(tried), size), np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_numpy().astype(float)
            p = np.column_stack([b.column(f"p_{d}").to_numpy() for d in DOMAINS]) * present
            unit = np.maximum(p.sum(1), 1e-9)
            for i, prices in enumerate(tried):
                x, worth = replay(p, prices)
                out[i, :k] += (n * x) @ p
                out[i, k:-1] += ((p * (n * (x > 0))[:, None]).T @ p).ravel()
                out[i, -1] += n @ (x * x)
                low[i] = np.minimum(low[i], (worth / unit).min())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel()), pa.array(low.ravel())], ["k", "v", "low"])

    return run


def solve(table: DataFrame, targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prices, totals, wanted) for table (n_tokens, p_*); raises if `steps` steps don't settle each domain."""
    k = len(DOMAINS)
    size = k + k * k + 1

    present = np.ones(k)

    def totals(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        rows = table.mapInArrow(_totals(tried, present), "k long, v double, low double").groupBy("k").agg(F.sum("v").alias("v"), F.min("low").alias("low")).collect()
        got = np.zeros((len(tried) * size, 2))
        for r in rows:
            got[r.k] = r.v, r.low
        return [(g[:k, 0], g[k:-1, 0].reshape(k, k), g[-1, 0], g[0, 1]) for g in got.reshape(len(tried), size, 2)]

    prices = np.zeros(k)
    total, gram, _, low = totals([prices])[0]
    if (total < GRAIN * total.sum()).any():
        present = np.where(total < GRAIN * total.sum(), 0.0, 1.0)
        total, gram, _, low = totals([prices])[0]
    wanted = total * np.array([targets[d] for d in DOMAINS])
    near = np.maximum(tolerance * np.maximum(np.where(wanted > 0, wanted, total), 1.0), GRAIN / 10 * total.sum())
    top = float(np.linalg.eigvalsh(gram).max())
    if top <= 0:
        return prices, total, wanted
    weight = 1e-4 * top  # of the rates' distance from 1
    for step in range(steps + 1):
        miss = total - wanted
        # of the distance to the targets: any u with p . u >= 0 for all documents bounds it from below
        u = weight * prices + max(0.0, -weight * low)
        if u @ u > 0:
            u *= max(0.0, -(u @ wanted) / (u @ u))
        gap = max(0.0, miss @ miss / 2 + u @ u / 2 + u @ wanted)
        if (np.abs(miss) <= near).all() or np.sqrt(2 * gap) <= near.min() or np.sqrt(2 * gap) <= FLOOR * np.linalg.norm(wanted) < 0.1 * np.linalg.norm(miss):
            return prices, total, wanted
        if step == steps:
            break
        slope = weight * prices - miss
        if np.linalg.norm(slope) <= 0.1 * np.linalg.norm(weight * prices) or np.abs(slope).max() < 0.1 * near.min():
            weight *= 0.1
            slope = weight * prices - miss
        move = np.linalg.solve(gram + weight * np.eye(k), slope)
        tried = [prices - length * move for length in LENGTHS]
        got = totals(tried)
        best = int(np.argmin([weight / 2 * t @ t + g[2] / 2 + wanted @ t for t, g in zip(tried, got)]))
        prices, (total, gram, _, low) = tried[best], got[best]
    raise RuntimeError(f"the mixing rates did not converge in {steps} steps: totals {total.tolist()}, wanted {wanted.tolist()}, within {near.tolist()}; the distance to the targets may exceed the least one by {np.sqrt(2 * gap)} tokens")


def _rate(prices: np.ndarray) -> Column:
    worth = sum((F.lit(float(x)) * F.col(f"p_{d}") for x, d in zip(prices, DOMAINS)), F.lit(0.0))
    return F.when(F.col("n_tokens") > 0, F.greatest(1 - worth, F.lit(0.0))).otherwise(1.0)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, fit_rows: int = linear.FIT_ROWS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, rate) for each row of docs; `fit_rows` bounds the classifier's labelled sample."""
    model = domain_model(docs, labels, fit_rows)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *POSTERIORS])
    table = durable(docs.select("doc_id", "text").mapInArrow(_posteriors(model, "doc_id"), schema))
    prices, _, _ = solve(table.filter("n_tokens > 0").drop("doc_id"), targets)
    return table.withColumn("rate", _rate(prices))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, fit_rows: int = linear.FIT_ROWS) -> DataFrame:
    """docs, each row as often as its rate says: floor(rate) times, and once more with probability its fraction.

    The draw is a hash of (doc_id, text), so it is the same on every run. Texts are
    read once: rows are kept with their posteriors, from which rates follow by the
    prices; nothing but statistics is shuffled. Null and empty texts have rate 1 and
    stay; columns are those of docs, whatever their names; an empty table gives none.
    """
    model = domain_model(docs, labels, fit_rows)
    tagged = docs.select(whole_row(docs).alias("__row"))
    table = durable(tagged.mapInArrow(_posteriors(model, "__row"), StructType([tagged.schema["__row"], *POSTERIORS])))
    prices, _, _ = solve(table.filter("n_tokens > 0").drop("__row"), targets)
    draw = F.pmod(F.xxhash64("__row.doc_id", "__row.text", F.lit(11)), F.lit(1000003)) / F.lit(1000003.0)
    rate = table.select("__row", _rate(prices).alias("rate"), draw.alias("draw"))
    n = rate.select("__row", F.expr("cast(floor(rate) as int) + if(draw < rate - floor(rate), 1, 0)").alias("n")).filter("n > 0")
    return unpacked(n.withColumn("again", F.explode(F.sequence(F.lit(1), "n"))), "__row", docs.columns)
