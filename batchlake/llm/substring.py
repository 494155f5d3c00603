"""Operator 9: repeated paragraphs and passages, by MinHash banding.

Two kinds of units are looked for, in one pass over the texts:

* paragraphs: lines of at least `min_paragraph` words. Their word-trigram sets
  get MinHash signatures, cut into bands whose number and width are tuned for
  high recall at the Jaccard threshold. All pairs of paragraphs that meet in a
  band are verified by their exact Jaccard similarity, and near copies are the
  connected components of verified pairs.
* pieces: a text's words cut at places that depend on the neighbouring words
  only (a pair of words whose hash is the least of `2 * REACH + 1`), so that a
  passage inside a longer paragraph is cut in the same places wherever it
  stands. Their band is the hash of the whole piece; pieces are equal if a second,
  independent hash of them agrees too (92 bits together).

Before units are shuffled, each task settles what it holds alike: of equal units
only the first goes to the others of its key, the further ones are known to be
copies and only look up where the first of all is. So boilerplate that stands in a
third of all documents brings one row a task to its key, not one a document.

Of each component, and of each set of equal pieces, the first by (doc_id,
text hash, place) stays. A paragraph that is not the first goes; pieces go where
adjoining ones that are not the first have at least `min_run` words together.
Spans of one document that overlap or touch are merged.

Cases: a null doc_id or text is passed over (its row stays as it is); an empty
text has no unit; repeated rows (same doc_id and text) count as one document and
are treated alike; repeats within one document are found too; boilerplate
shorter than `min_run` words stays; an empty table gives no rows; other columns
are ignored. A text may have at most 2**31 characters. doc_id is an integer, or can be
cast to one; texts of one doc_id are told apart by 16 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import words as tw
from .components import components, local_labels
from .durable import durable, quoted, whole_row

REACH = 4
SAME = 16
MIN_PARAGRAPH, MIN_RUN, JACCARD, RECALL = 20, 20, 0.7, 0.96
PIECE = 15  # in the lowest 4 bits of a key: the band, or this for a piece
BROADCAST_ROWS = 1_000_000  # beyond, a shuffle join gives the same rows
CUT_ROWS = 256
HELD_UNITS = 1 << 19  # of a task, before it settles them
LATER, MORE = np.int64(-(1 << 63)), np.int64(1 << 31)  # in a span: not the first of its task's equal units; a first one that has such
UNIT_SCHEMA = "key long, content long, doc_id long, pos long, span long"


def tune(threshold: float, recall: float, hashes: int = 24, most_bands: int = 14) -> tuple[int, int]:
    """(bands, rows): the widest bands with which pairs at the threshold meet with probability `recall`."""
    fits = [(b, r) for r in range(1, hashes + 1) for b in range(1, min(most_bands, hashes // r) + 1) if 1 - (1 - threshold**r) ** b >= recall]
    if not fits:
        raise ValueError("no bands reach this recall with so few hashes")
    return max(fits, key=lambda x: (x[1], -x[0]))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def cuts(w: tw.Words) -> np.ndarray:
    """Where pieces start: the first word of each document, and each word whose pair with the next has the least hash around."""
    n = len(w.hash)
    v = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if n > 1:
        v[:-1] = tw.combine(w.hash[:-1], w.hash[1:])
    at = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        other = w.doc[:-d] != w.doc[d:]
        at[:-d] &= other | (v[:-d] < v[d:])
        at[d:] &= other | (v[d:] < v[:-d])
    if n:
        new = np.append(True, w.doc[1:] != w.doc[:-1])
        # one word again and again has no least place: such a run is cut into stretches of SAME words
        start = np.flatnonzero(new | np.append(True, w.hash[1:] != w.hash[:-1]))
        length = np.diff(np.append(start, n))
        start, length = start[length >= SAME], length[length >= SAME]
        at[(start + length)[start + length < n]] = True
        many = length // SAME
        first = np.cumsum(many) - many
        at[np.repeat(start, many) + SAME * (np.arange(int(many.sum())) - np.repeat(first, many))] = True
        at |= new
    return np.flatnonzero(at)


def lines(w: tw.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the lines that have words."""
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
    start = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])))
    return start, np.append(start[1:], len(line))


def trigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of h[i], h[i+1], h[i+2] for each i; the last two have no meaning."""
    t = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        t[:-2] = tw.combine(tw.combine(h[:-2], h[1:-1]), h[2:])
    return t


def _inside(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the trigrams of word ranges of at least 3 words, and where each range begins among them."""
    n = end - start - 2
    begin = np.cumsum(n) - n
    return np.repeat(start - begin, n) + np.arange(int(n.sum())), begin


class _Places:
    """Packs a unit's place: text salt, index and words in `pos`; characters from and to in `span`."""

    def __init__(self, w: tw.Words, tk: np.ndarray) -> None:
        self.w = w
        self.salt = (tk.view(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)
        chars = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
        self.first = chars[w.start]
        self.last = chars[w.end]
        self.zero = chars[w.offsets[:-1]]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.w.doc[start]
        at, n = tw.runs(doc)
        index = (np.arange(len(doc)) - np.repeat(at, n)).astype(np.uint64)
        # of words it only matters whether `min_run` are together
        pos = self.salt[doc] | (index << np.uint64(16)) | np.minimum(end - start, 0xFFFF).astype(np.uint64)
        span = ((self.first[start] - self.zero[doc]) << 32) | (self.last[end - 1] - self.zero[doc])
        return _signed(pos), span


def _settled(units: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A task's units, of which those that have equals here are marked as LATER or as the first with MORE; of bands but 0 only firsts are needed."""
    key, content, doc, pos, span = (np.concatenate(x) for x in zip(*units))
    o = np.argsort(key, kind="stable")
    _, n = tw.runs(key[o])
    single = np.repeat(n == 1, n)
    alone, o = o[single], o[~single]
    o = o[np.lexsort((pos[o], doc[o], content[o], key[o]))]
    k, c, d, p = key[o], content[o], doc[o], pos[o]
    same = np.zeros(len(o), bool)
    same[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    row = np.ones(len(o), bool)  # rows of repeated documents count once
    row[1:] = ~(same[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1]))
    o, k, same = o[row], k[row], same[row]
    full = (k & 15 == PIECE) | (k & 15 == 0)
    more = np.append(same[1:], False)[: len(o)] & ~same & full
    span[o] |= np.where(same, LATER, np.where(more, MORE, 0))
    o = np.concatenate([alone, o[full | ~same]])
    return pa.RecordBatch.from_arrays([pa.array(x[o]) for x in (key, content, doc, pos, span)], ["key", "content", "doc_id", "pos", "span"])


def _units(bands: int, rows: int, min_paragraph: int):
    odd = tw.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    other = np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            ids, tks = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tk").to_numpy(zero_copy_only=False)
            for at, part in tw.slices(b.column("text")):
                w = tw.words(part, lower="ascii")
                if len(w.hash) == 0:
                    continue
                places = _Places(w, tks[at : at + len(part)])

                def hold(key: np.ndarray, content: np.ndarray) -> None:
                    held.append((_signed(key), _signed(content), ids[at + w.doc[start]], *placed))

                start = cuts(w)
                end = np.append(start[1:], len(w.hash))
                placed = places(start, end)
                hold(tw.spans(w.hash, start, end) | np.uint64(15), tw.spans(tw.mix(w.hash ^ other), start, end) >> np.uint64(32))
                start, end = lines(w)
                placed = places(start, end)
                long = end - start >= max(min_paragraph, 3)
                if long.any():
                    start, end, placed = start[long], end[long], tuple(x[long] for x in placed)
                    content = tw.spans(w.hash, start, end)
                    index, begin = _inside(start, end)
                    t = trigrams(w.hash)[index]
                    for band in range(bands):
                        key = np.full(len(start), band, np.uint64)
                        for r in range(rows):
                            with np.errstate(over="ignore"):
                                key = tw.combine(key, np.minimum.reduceat(t * odd[band * rows + r] >> np.uint64(20), begin))
                        hold(key & ~np.uint64(15) | np.uint64(band), content)
                if sum(len(x[0]) for x in held) >= HELD_UNITS:
                    yield _settled(held)
                    held.clear()
        if held:
            yield _settled(held)

    return run


MET_SCHEMA = "kind int, key long, content long, doc_id long, pos long, span long, kept_doc_id long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What units that meet in a key are.

    kind 1: a piece that is not the first; 0: each of equal paragraphs; 2: a paragraph
    of each content in a band where contents differ; 3: a piece of which its task had
    an equal one before, so that it is not the first, passed on; 4: the first of the
    pieces that such ones are equal to.
    """
    names = ["key", "content", "doc_id", "pos", "span"]

    def out(kind: int, cols: list[np.ndarray], kept: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), kind, np.int32)), *(pa.array(x) for x in cols), pa.array(kept)], ["kind", *names, "kept_doc_id"])

    got = []
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        later = cols[4] < 0
        if later.any():
            x = [c[later] for c in cols]
            x[4] = x[4] & ~LATER
            for kind, some in ((3, x[0] & 15 == PIECE), (0, x[0] & 15 == 0)):
                if some.any():
                    yield out(kind, [c[some] for c in x], x[2][some])
            cols = [c[~later] for c in cols]
        if len(cols[0]):
            got.append(cols)
    if not got:
        return
    key, content, doc, pos, span = (np.concatenate(x) for x in zip(*got))
    del got
    o = np.argsort(key)
    at, n = tw.runs(key[o])
    o = o[np.repeat(n > 1, n) | (span[o] & MORE != 0)]  # most keys are single
    if len(o) == 0:
        return
    o = o[np.lexsort((pos[o], doc[o], content[o], key[o]))]
    key, content, doc, pos, more = key[o], content[o], doc[o], pos[o], span[o] & MORE != 0
    span = span[o] & ~MORE
    new = np.ones(len(key), bool)  # rows of repeated documents count once
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    more = np.maximum.reduceat(more, np.flatnonzero(new))
    key, content, doc, pos, span = (x[new] for x in (key, content, doc, pos, span))
    at, n = tw.runs(key)
    group = np.repeat(np.arange(len(at)), n)
    band = key & 15
    new_content = np.ones(len(key), bool)
    new_content[1:] = (group[1:] != group[:-1]) | (content[1:] != content[:-1])
    contents = np.add.reduceat(new_content.astype(np.int64), at)[group]
    begin = np.flatnonzero(new_content)
    first = np.repeat(begin, np.diff(np.append(begin, len(key))))  # of the rows of a content in a key
    copies = np.repeat(np.diff(np.append(begin, len(key))), np.diff(np.append(begin, len(key))))
    known = np.maximum.reduceat(more, begin)[np.cumsum(new_content) - 1]
    for kind, rows in (
        (1, np.flatnonzero((band == PIECE) & ~new_content)),
        (4, np.flatnonzero((band == PIECE) & new_content & known)),
        (0, np.flatnonzero((band == 0) & ((copies > 1) | more))),
        (2, np.flatnonzero((band != PIECE) & (contents > 1) & new_content)),
    ):
        if len(rows):
            yield out(kind, [x[rows] for x in (key, content, doc, pos, span)], doc[first[rows]])


def _shingles(min_paragraph: int):
    """For the paragraphs listed with each document: (key, content, sorted trigrams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need = b.column("need").to_pylist()
            for at, part in tw.slices(b.column("text")):
                w = tw.words(part, lower="ascii")
                if len(w.hash) == 0:
                    continue
                start, end = lines(w)
                content = _signed(tw.spans(w.hash, start, end))
                long = np.flatnonzero(end - start >= max(min_paragraph, 3))
                t = trigrams(w.hash)
                by = {(int(w.doc[start[k]]), int(content[k])): k for k in long}
                keys, contents, sets = [], [], []
                for d in range(len(part)):
                    for x in need[at + d]:
                        if (k := by.get((d, x["content"]))) is not None:
                            keys.append(x["key"])
                            contents.append(x["content"])
                            sets.append(np.unique(t[start[k] : end[k] - 2]).tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(sets, pa.binary())], ["key", "content", "set"])

    return run


def _similar(threshold: float):
    """Verifies all pairs of a band's contents by exact Jaccard; a spanning forest of the similar ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, content = t.column("key").to_numpy(), t.column("content").to_numpy()
        sets = t.column("set").combine_chunks()
        off = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1] // 8
        values = np.frombuffer(sets.buffers()[2], np.uint64)
        order = np.lexsort((content, key))
        at, n = tw.runs(key[order])
        a, b = [], []
        for s, m in zip(at[n > 1].tolist(), n[n > 1].tolist()):
            rows = order[s : s + m]
            rows = rows[np.append(True, content[rows][1:] != content[rows][:-1])]
            m = len(rows)
            size = off[rows + 1] - off[rows]
            member = np.repeat(np.arange(m), size)
            v = np.concatenate([values[off[r] : off[r + 1]] for r in rows])
            _, v = np.unique(v, return_inverse=True)
            o = np.argsort(v, kind="stable")
            v, member = v[o], member[o]
            start, count = tw.runs(v)
            # shared shingles of all pairs: products of the incidence matrix, of which only shared columns matter
            shared = np.flatnonzero(count > 1)
            column = np.full(len(count), -1)
            column[shared] = np.arange(len(shared))
            column = np.repeat(column, count)
            member, column = member[column >= 0], column[column >= 0]
            i_all, j_all = [], []
            width = max(1, (1 << 22) // m)
            step = max(1, (1 << 22) // m)
            for lo in range(0, m, step):
                both = np.zeros((min(step, m - lo), m), np.float32)
                for at_column in range(0, len(shared), width):
                    part = slice(*np.searchsorted(column, (at_column, at_column + width)))
                    a_part = np.zeros((m, min(width, len(shared) - at_column)), np.float32)
                    a_part[member[part], column[part] - at_column] = 1
                    both += a_part[lo : lo + step] @ a_part.T
                union = size[lo : lo + step][:, None] + size[None, :] - both
                i, j = np.nonzero(both >= threshold * union)
                i_all.append(i + lo)
                j_all.append(j)
            i, j = np.concatenate(i_all), np.concatenate(j_all)
            lab = local_labels(m, i[i != j], j[i != j])
            k = np.flatnonzero(lab != np.arange(m))
            a.append(content[rows[k]])
            b.append(content[rows[lab[k]]])
        if a:
            e = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def _known(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))


def repeats(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL, min_paragraph: int = MIN_PARAGRAPH, min_run: int = MIN_RUN) -> DataFrame:
    """Spans that go: (doc_id, salt, start, end, kept_doc_id), characters from 0, end exclusive.

    salt is the low 16 bits of xxhash64(text), as doc_id need not be unique;
    kept_doc_id has the first copy of (the least of) what the span is made of.
    """
    bands, rows = tune(jaccard, recall)
    known = _known(docs)
    units = known.mapInArrow(_units(bands, rows, min_paragraph), UNIT_SCHEMA)
    # what is known to be a copy need not meet its equals
    units = units.repartition(F.when(F.col("span") < 0, F.xxhash64("doc_id", "pos")).otherwise(F.col("key")))
    met = durable(units.mapInArrow(_met, MET_SCHEMA))
    differ = met.filter("kind = 2")
    need = differ.groupBy("doc_id", F.shiftright("pos", 48).alias("salt")).agg(F.collect_list(F.struct("key", "content")).alias("need"))
    need = durable(need.withColumnsRenamed({"doc_id": "__id", "salt": "__salt"}))
    if need.count() <= BROADCAST_ROWS:  # then only documents that are needed are shuffled to the list of what they need
        ids = need.select(F.col("__id").alias("doc_id"), F.col("__salt").alias("salt"))
        known = known.withColumn("salt", F.expr("shiftright(shiftleft(tk, 48), 48)")).join(F.broadcast(ids), ["doc_id", "salt"], "left_semi")
    joined = known.join(need, (F.col("doc_id") == F.col("__id")) & (F.expr("shiftright(shiftleft(tk, 48), 48)") == F.col("__salt"))).select("text", "need")
    edges = joined.mapInArrow(_shingles(min_paragraph), "key long, content long, set binary").repartition("key").mapInArrow(_similar(jaccard), "a long, b long")
    comp = components(edges)
    member = met.filter("kind in (0, 2)").select("content", "doc_id", "pos", "span").distinct()
    member = member.join(comp, F.col("content") == F.col("node"), "left").withColumn("g", F.coalesce("component", "content"))
    w = Window.partitionBy("g").orderBy("doc_id", "pos")
    later = member.withColumns({"r": F.row_number().over(w), "kept_doc_id": F.first("doc_id").over(w)}).filter("r > 1")
    salt, start, end = F.shiftright("pos", 48), F.shiftright("span", 32), F.expr("span & 4294967295")
    later = later.select("doc_id", salt.alias("salt"), start.alias("start"), end.alias("end"), "kept_doc_id")
    place = ["doc_id", "pos", "span", "kept_doc_id"]
    first = met.filter("kind = 4").select("key", "content", F.col("doc_id").alias("__doc"), F.col("pos").alias("__pos"))
    copy = met.filter("kind = 3").select("key", "content", "doc_id", "pos", "span").join(first, ["key", "content"])
    copy = copy.filter("not (doc_id = __doc and pos = __pos)").withColumn("kept_doc_id", F.col("__doc")).select(place)  # a row of the table may be there twice
    piece = met.filter("kind = 1").select(place).unionAll(copy).withColumn("salt", salt).repartition("doc_id", "salt")
    piece = piece.groupBy("doc_id", "salt", "pos").agg(F.min("span").alias("span"), F.min("kept_doc_id").alias("kept_doc_id"))
    piece = piece.select("doc_id", "salt", F.expr("shiftright(pos, 16) & 4294967295").alias("i"), F.expr("pos & 65535").alias("n"), start.alias("start"), end.alias("end"), "kept_doc_id")
    one = Window.partitionBy("doc_id", "salt")
    run = piece.withColumn("run", F.col("i") - F.row_number().over(one.orderBy("i"))).groupBy("doc_id", "salt", "run").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"))
    spans = later.unionAll(run.filter(F.col("n") >= min_run).select("doc_id", "salt", "start", "end", "kept_doc_id"))
    before = F.max("end").over(one.orderBy("start", "end", "kept_doc_id").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    spans = spans.withColumn("m", F.sum("new").over(one.orderBy("start", "end", "kept_doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "salt", "m").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id")).drop("m")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, CUT_ROWS):
            some, out = b.slice(lo, CUT_ROWS), []
            for text, spans in zip(some.column("__text").to_pylist(), some.column("__spans").to_pylist()):
                at, parts = 0, []
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    parts.append(text[at : s["start"]].rstrip(" "))
                    at = s["end"]
                if parts:
                    parts.append(text[at:])
                    text = "".join(parts).strip()
                out.append(text)
            yield pa.RecordBatch.from_arrays([some.column("__row"), pa.array(out, pa.string())], ["__row", "__text"])


def remove_repeats(docs: DataFrame, **how: float) -> DataFrame:
    """docs with the spans of repeats() cut out and `n_chars`, if there is one, counted anew.

    A document of which no letter or digit is left is dropped. Columns are those of
    docs, whatever their names; repeated rows are treated alike; null texts and doc_ids
    stay as they are; an empty table gives no rows.
    """
    spans = repeats(docs, **how).groupBy("doc_id", "salt").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    spans = durable(spans.withColumnsRenamed({"doc_id": "__id", "salt": "__salt"}))
    few = spans.count() <= BROADCAST_ROWS // 20
    # the row's other columns go by in one struct, so each text is there once
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(whole_row(docs.select([quoted(c) for c in others])).alias("__row"), F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"))
    d = d.join(F.broadcast(spans) if few else spans, (F.col("__doc") == F.col("__id")) & (F.expr("shiftright(shiftleft(xxhash64(__text), 48), 48)") == F.col("__salt")), "left")
    value = lambda c: F.col("__text") if c == "text" else F.col("__row").getField(c)
    same = d.filter("__spans is null").select([value(c).alias(c) for c in docs.columns])
    d = d.filter("__spans is not null").select("__row", "__text", "__spans")
    cut = d.mapInArrow(_cut, StructType([d.schema["__row"], StructField("__text", StringType())])).filter(F.col("__text").rlike(r"[\p{L}\p{N}]"))
    anew = F.length("__text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return same.unionAll(cut.select([(anew if c == "n_chars" else value(c)).alias(c) for c in docs.columns]))
