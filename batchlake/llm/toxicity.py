"""Operator 3: toxic documents by weak supervision.

Many voters look at each document and hit or stay silent: fixed lexicons (insults,
contempt, slurs on worth, threats), found lexicons (words and word beginnings that
occur in toxic documents nearly only, and more often than chance allows, in a bounded
sample of the labelled rows, dealt out to several voters: each is a small classifier
fitted on that sample), and patterns (an insult next to `you` or `your`, masked words,
shouting). A generative label model - the voters' hit rates in either class, and the
correlations of voters within a class - is estimated by EM from the counts of all vote
patterns of the whole table. It sees no label: lexicons are believed at the start,
patterns are not, and the share of toxic documents is anchored in the share of
documents that any lexicon hits. A linear classifier on text features and votes is
then trained on the model's posteriors of the labelled sample, and scores every document.

Cases: without labels only the fixed lexicons and patterns vote, and the classifier is
trained on vote patterns; where no lexicon hits, nothing is toxic; a null text is
an empty one, without hits; repeated rows and null doc_ids are scored each; of several
labels of a doc_id the greatest counts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import linear, words as tw
from .durable import durable

KINDS = "up"
LEXICONS: dict[str, str] = {
    "insult": "idiot idiots moron morons loser losers clown clowns imbecile dumbass jackass bastard bitch asshole fool dummy idiota imbécil estúpido estúpida idiote imbécile crétin connard salaud arschloch trottel dummkopf vollidiot",
    "contempt": "pathetic stupid disgusting worthless dumb ridiculous useless repulsive filthy despicable dégoûtant minable ekelhaft erbärmlich wertlos asqueroso patético inútil",
    "slur_on_worth": "scum trash garbage vermin filth parasite pig pigs rat rats subhuman abschaum müll ordure racaille basura escoria",
    "threat": "kill die hate destroy murder hurt töten hassen tuer haïr matar odiar",
}
PERSON = "you your youre du dein ihr tu vous votre tú eres usted"
FOUND, CUT = 8, 0.3
PATTERNS = ("person_insult", "masked", "shouting")
#: name of each voter, its bit is its place
VOTERS = [*LEXICONS, *PATTERNS, *(f"found_{k}" for k in range(FOUND))]
#: The voters that are believed at the start.
LEXICAL = sum(1 << k for k, name in enumerate(VOTERS) if name not in PATTERNS)
#: A lexicon word that is also in common use only counts together with others.
WEAK = {"die", "pig", "pigs", "rat", "rats", "fool", "du", "hate", "kill", "hurt", "destroy"}


def _hashes(words: str) -> np.ndarray:
    return np.unique(np.array([tw.word_hash(w) for w in words.split()], np.uint64))


def bits(votes: np.ndarray) -> np.ndarray:
    """(votes, voters) of 0 and 1."""
    return ((votes[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


def found_lexicon(texts: pa.ChunkedArray, y: np.ndarray, precision: float = 0.9, significant: float = 20.0) -> np.ndarray:
    """Hashes of words and beginnings that occur in toxic documents of the sample beyond chance.

    One qualifies if it is in at least 3 documents, at least `precision` of these are toxic, and
    the likelihood ratio of its share in toxic documents and in others is significant; a
    beginning also needs 3 different words, as it stands for a stem.
    """
    rate = float(np.mean(y)) if len(y) else 0.0
    if not 0 < rate < 1:
        return np.zeros(0, np.uint64)
    # of each slice only distinct (id, document) pairs are kept, 41 bits of the id and 23 of the document, sorted by id
    seen, base = [np.zeros(0, np.uint64)], 0
    for _, part in tw.slices(texts):
        w = tw.words(part)
        seen += [np.unique((h & ~np.uint64((1 << 23) - 1)) | (w.doc[at] + base).astype(np.uint64)) for at, h in linear.each(w, KINDS)]
        base += len(part)
    if base >= 1 << 23:
        raise ValueError("the labelled sample has too many rows")
    key = np.concatenate(seen)
    del seen
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    is_toxic = y[(key & np.uint64((1 << 23) - 1)).astype(np.int64)] > 0
    key >>= np.uint64(23)
    known, toxic = np.unique(key[is_toxic], return_counts=True)
    n = np.searchsorted(key, known, "right") - np.searchsorted(key, known)
    statistic, _ = linear.ratios(np.stack([n - toxic, toxic]), np.array([1 - rate, rate]) * len(y))
    known = known[(n >= 3) & (toxic >= precision * n) & (statistic[1] > significant)]
    # what qualifies is looked up in full, with the words that it begins
    pairs, base = [np.zeros((0, 2), np.uint64)], 0
    for _, part in tw.slices(texts):
        w = tw.words(part)
        for at, h in linear.each(w, KINDS):
            hit = np.flatnonzero((y[w.doc[at] + base] > 0) & np.isin(h >> np.uint64(23), known))
            pairs.append(np.unique(np.stack([h[hit], w.hash[at[hit]]], axis=1), axis=0))
        base += len(part)
    pairs = np.unique(np.concatenate(pairs), axis=0)
    entry, words = np.unique(pairs[:, 0], return_counts=True)
    return entry[np.isin(entry, pairs[pairs[:, 0] == pairs[:, 1], 0]) | (words >= 3)]


class Voters:
    """All voters, as one pass over a slice of texts."""

    def __init__(self, found: np.ndarray) -> None:
        own = [_hashes(" ".join(w for w in ws.split() if w not in WEAK)) for ws in LEXICONS.values()]
        every, person = _hashes(" ".join(LEXICONS.values())), _hashes(PERSON)
        self.words = tw.Lookup(np.concatenate([every, person]))
        self.bit = sum(np.where(np.isin(self.words.members, h), 1 << k, 0) for k, h in enumerate(own))
        self.insult, self.person = np.isin(self.words.members, every), np.isin(self.words.members, person)
        self.found = tw.Lookup(found)

    def __call__(self, part: pa.Array, w: tw.Words) -> np.ndarray:
        votes = np.zeros(w.docs, np.int64)
        at, word = self.words(w.hash)
        np.bitwise_or.at(votes, w.doc[at], self.bit[word])
        k = len(LEXICONS)
        if len(at) > 1:
            next_ = (at[1:] == at[:-1] + 1) & (w.doc[at[1:]] == w.doc[at[:-1]])
            a, b = word[:-1], word[1:]
            votes[w.doc[at[1:]][next_ & ((self.insult[a] & self.person[b]) | (self.person[a] & self.insult[b]))]] |= 1 << k
        votes[self._masked(part)] |= 1 << k + 1
        votes[self._shouting(part)] |= 1 << k + 2
        if len(self.found.members):
            for place, h in linear.each(w, KINDS):
                at, which = self.found(h)
                np.bitwise_or.at(votes, w.doc[place[at]], np.int64(1) << (k + len(PATTERNS) + (self.found.members[which] % np.uint64(FOUND)).astype(np.int64)))
        return votes

    @staticmethod
    def _masked(part: pa.Array) -> np.ndarray:
        """Documents with a word in which a letter on each side embraces `*`, `@` or `#`."""
        w = tw.words(part, lower=False, inside=tw.PUNCTUATED)
        if len(w.hash) < 3:
            return np.zeros(0, np.int64)
        mask = np.isin(w.data[w.start], np.frombuffer(b"*@#", np.uint8)) & (w.end - w.start <= 3)
        near = mask[1:-1] & (w.start[1:-1] == w.end[:-2]) & (w.start[2:] == w.end[1:-1]) & (w.end[:-2] - w.start[:-2] <= 2)
        near &= (w.doc[:-2] == w.doc[1:-1]) & (w.doc[2:] == w.doc[1:-1])
        return w.doc[1:-1][near]

    @staticmethod
    def _shouting(part: pa.Array) -> np.ndarray:
        """Documents of at least 40 letters, nearly all of them capitals, and with `!!`."""
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        if part.buffers()[2] is None or off[-1] == off[0]:
            return np.zeros(0, np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        count = lambda m: np.diff(np.append(0, np.cumsum(m))[off])
        upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
        bang = np.append((data[1:] == 33) & (data[:-1] == 33), False)
        return np.flatnonzero((upper + lower >= 40) & (upper > 0.8 * (upper + lower)) & (count(bang) > 0))


def label_model(patterns: np.ndarray, counts: np.ndarray, voters: int, lexical: int, rounds: int = 300) -> dict:
    """The generative model of vote patterns, by EM without labels.

    patterns: distinct bitmasks; counts: how many documents have each; lexical: mask of
    the voters that are believed at the start. In class c voter j hits with probability
    rate[c, j]. A vote (a hit or a miss) tells the logarithm of its probabilities' ratio,
    divided by 1 + the correlations, within a class, of j with the other voters that
    vote alike, as correlated voters repeat each other. Rates and correlations are
    estimated anew each round from the counts, with the mean of the posterior and the
    belief of the start, as one class is not told from the other by few voters, or by
    ones that repeat each other, alone; the share of class 1 is held at `balance`, the
    share of documents with a lexical hit (half of them at most).
    Returns balance, rate (2 x voters), correlation (voters x voters) and posterior of each pattern.
    """
    m = ((patterns[:, None] >> np.arange(voters)) & 1).astype(float)
    n, hit = counts.astype(float), (patterns & lexical) != 0
    balance = min(float(n[hit].sum() / max(n.sum(), 1.0)), 0.5)
    belief = np.where(hit, 0.9, 0.01)
    post, rate, corr = belief, np.zeros((2, voters)), np.zeros((voters, voters))
    if balance == 0:
        return {"balance": 0.0, "rate": rate, "correlation": corr, "posterior": np.zeros(len(n))}
    for _ in range(rounds):
        corr = np.zeros((voters, voters))
        mean = (post + belief) / 2
        for c, p in enumerate((n * (1 - mean), n * mean)):
            mass = p.sum()
            rate[c] = (p @ m + 1e-3) / (mass + 2e-3)
            d = m - rate[c]
            cov = (d * p[:, None]).T @ d / max(mass, 1.0)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            seen = rate[c] * mass >= 5  # rarer voters' correlations are chance
            corr = np.maximum(corr, np.where(np.outer(seen, seen), cov / np.outer(sd, sd), 0))
        corr = np.where(corr > 0.05, np.minimum(corr, 1.0), 0.0) * (1 - np.eye(voters))
        tells = (m / (1 + m @ corr)) @ np.log(rate[1] / rate[0]) + ((1 - m) / (1 + (1 - m) @ corr)) @ np.log((1 - rate[1]) / (1 - rate[0]))
        low, high = -60.0, 60.0
        for _ in range(60):  # the logit at which the mean posterior is the balance
            logit = (low + high) / 2
            new = 1 / (1 + np.exp(-np.clip(tells + logit, -40, 40)))
            low, high = (low, logit) if n @ new > balance * n.sum() else (logit, high)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return {"balance": balance, "rate": rate, "correlation": corr, "posterior": post}


def _vote_pass(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in tw.slices(b.column("text")):
                votes, n = np.unique(voters(part, tw.words(part)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(n)], ["votes", "n"])

    return run


def train(texts: pa.ChunkedArray, votes: np.ndarray, posterior: np.ndarray, patterns: np.ndarray, counts: np.ndarray, share: np.ndarray) -> linear.Chosen:
    """The linear classifier, trained on posterior labels: of the labelled rows (texts, votes, posterior), or of all vote patterns where there are none.

    The labelled rows may hold another share of toxic documents than the table, so each
    weighs as much as its vote pattern is more frequent in the table than among them.
    """
    both = lambda p: np.stack([1 - p, p], axis=1)
    if not len(votes):
        row, slot = np.nonzero(bits(patterns))
        ptr = np.searchsorted(row, np.arange(len(patterns) + 1))
        m = linear.fit_softmax(ptr, slot.astype(np.int32), both(share), len(VOTERS).bit_length(), KINDS, steps=300, value=np.ones(len(slot)), times=counts.astype(float))
        return linear.Chosen(np.zeros(0, np.int64), np.zeros((0, 2)), m.bias, KINDS, m.weight[: len(VOTERS)].astype(float))
    at = np.searchsorted(patterns, votes)
    return linear.fit_chosen(texts, both(posterior), KINDS, bits(votes), times=counts[at] / np.bincount(at, minlength=len(patterns))[at])


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = linear.FIT_ROWS, cut: float = CUT) -> DataFrame:
    """(doc_id, votes, posterior, score, toxic) for each row of docs.

    votes: bitmask of VOTERS that hit; posterior: the label model's probability;
    score: the classifier's probability; toxic: score > `cut`, which is below 0.5 as
    posteriors of documents with few hits are. `fit_rows` bounds the
    labelled rows that lexicons are found in and the classifier is trained on.
    """
    d = docs.select("doc_id", "text")
    y = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    got = linear.sample(d, y, fit_rows)
    texts = got.column("text")
    voters = Voters(found_lexicon(texts, (got.column("y").to_numpy() > 0).astype(np.int64)))
    seen = np.concatenate([np.zeros(0, np.int64), *(voters(part, tw.words(part)) for _, part in tw.slices(texts))])
    voted = durable(d.select("text").mapInArrow(_vote_pass(voters), "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")))
    counted = voted.orderBy("votes").toArrow()  # at most 2**len(VOTERS) rows whatever the table's size
    patterns, counts = counted.column("votes").to_numpy(), counted.column("n").to_numpy()
    if not len(patterns):
        patterns, counts = np.zeros(1, np.int64), np.ones(1, np.int64)
    posterior = label_model(patterns, counts, len(VOTERS), LEXICAL)["posterior"]
    # a row that was drawn is a row of the table, so its pattern is known
    classifier = train(texts, seen, posterior[np.searchsorted(patterns, seen)] if len(seen) else np.zeros(0), patterns, counts, posterior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in tw.slices(b.column("text")):
                w = tw.words(part)
                votes = voters(part, w)
                s = classifier.scores(w, bits(votes))
                s = 1 / (1 + np.exp(-np.clip(s[:, 1] - s[:, 0], -40, 40)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(votes), pa.array(posterior[np.searchsorted(patterns, votes)]), pa.array(s), pa.array(s > cut)], ["doc_id", "votes", "posterior", "score", "toxic"])

    kinds = {"votes": LongType(), "posterior": DoubleType(), "score": DoubleType(), "toxic": BooleanType()}
    return d.mapInArrow(run, StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, t) for c, t in kinds.items())]))
