"""Near duplicates, repeated passages and neighbours, against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchlake.llm import components, neighbours, simhash, substring, words as tw
from prose import edited, prose

def test_words_and_hashes():
    texts = pa.array(["Ab cd, ab", "", "É x", "cd"], pa.large_string())
    w = tw.words(texts)
    assert w.doc.tolist() == [0, 0, 0, 2, 2, 3] and w.hash[0] == w.hash[2] == tw.word_hash("ab") and w.hash[1] == w.hash[5]
    assert len(tw.words(pa.array(["a,b !!"], pa.large_string()), False, tw.PUNCTUATED).hash) == 4
    assert [len(p) for _, p in tw.slices(pa.array(["x"] * 5 + [None]))] == [6] and list(tw.slices(pa.array([], pa.string()))) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(500):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_allocation_covers_the_radius():
    pairs = [np.array([1, 2, 4, 8, 16, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], float) * k for k in (1, 9, 3, 100)]
    for radius in (0, 3, 7, 11):
        t = simhash.allocate(pairs, [16] * 4, 1000, radius)
        assert sum(x + 1 for x in t) >= radius + 1 and min(t) >= -1
    hist = np.zeros(16, np.int64)
    hist[[0, 1, 3, 12]] = [3, 2, 1, 5]
    vals = np.repeat(np.arange(16), hist)
    want = np.bincount([int(a ^ b).bit_count() for a, b in combinations(vals, 2)], minlength=5)
    assert np.allclose(simhash.meetings(hist), want)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(40, 200)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(base)]
    planted = []
    for k in range(60):
        i = rng.randrange(150)
        planted.append((i, len(rows)))
        rows.append((len(rows), base[i] if k % 3 == 0 else edited(rng, base[i], 0.04)))
    for k in range(40):  # a large group
        rows.append((len(rows), edited(rng, base[0], 0.03)))
        planted.append((0, len(rows) - 1))
    return rows, planted


def brute_groups(rows, radius=11, confirm=38):
    w = tw.words(pa.array([t for _, t in rows], pa.large_string()))
    n, s = simhash.sketch(w)
    d0 = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0])
    d = np.bitwise_count(s[:, None] ^ s[None]).sum(2)
    ok = (d0 <= radius) & (d <= confirm)
    i, j = np.nonzero(ok)
    lab = components.local_labels(len(rows), i, j)
    return {rows[k][0]: rows[lab[k]][0] for k in range(len(rows)) if lab[k] != k}


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows, planted = corpus
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(d).collect()}
    assert got == brute_groups(rows)
    found = sum(got.get(b, b) == got.get(a, a) for a, b in planted)
    assert found >= 0.9 * len(planted)
    gone = {b for _, b in planted}
    assert set(got) <= gone


def test_near_duplicates_edge_cases(spark):
    rng = random.Random(2)
    t = prose(rng, 50)
    rows = [(1, None, "x"), (None, t, "x"), (2, "", "x"), (3, "", "x"), (4, "!!", "x"), (5, t, "x"), (5, t, "x"), (5, prose(rng, 50), "y"), (6, t.upper(), "x"), (7, prose(rng, 40_000), "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("f0", F.lit(1))
    got = sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_duplicates(d).collect())
    assert got == [(3, 2), (6, 5)]
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 2, 4, 5, 5, 7]
    assert simhash.drop_near_duplicates(d.filter("false")).count() == 0 and simhash.near_duplicates(d.filter("false")).count() == 0


# ---- repeated passages


def test_bands_are_tuned():
    for j, recall in ((0.7, 0.96), (0.5, 0.9), (0.9, 0.99)):
        b, r = substring.tune(j, recall)
        assert 1 - (1 - j**r) ** b >= recall and b * r <= 24
    with pytest.raises(ValueError):
        substring.tune(0.1, 0.999, 4)


def covered(spans, a, b):
    return sum(max(0, min(b, e) - max(a, s)) for s, e in spans) / (b - a)


def test_passages_inside_paragraphs(spark):
    rng = random.Random(5)
    passages = [prose(rng, 60) for _ in range(20)]
    rows, at = [], []
    for i in range(120):
        text = prose(rng, rng.randint(60, 160))
        if i % 2:
            p = passages[i // 2 % 20]
            head = text[: text.index(" ", len(text) // 2)]
            at.append((i, i // 2 % 20, len(head) + 1, len(head) + 1 + len(p)))
            text = f"{head} {p} {text[len(head) + 1 :]}"
        rows.append((i, text))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {}
    for r in substring.repeats(d).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    first = {}
    hits = []
    for i, p, a, b in at:
        if first.setdefault(p, i) != i:
            hits.append(covered(spans.get(i, []), a, b))
    assert np.mean([h > 0.4 for h in hits]) >= 0.95 and np.mean(hits) > 0.6
    assert set(spans) <= {i for i, p, *_ in at if first[p] != i}
    cut = {r.doc_id: r.text for r in substring.remove_repeats(d).collect()}
    for p in passages:
        assert sum(p in t for t in cut.values()) == 1


def brute_paragraphs(rows, threshold):
    units = [(i, k, line) for i, t in rows for k, line in enumerate(t.split("\n")) if len(line.split()) >= 20]
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (u[2].split() for u in units)]
    pairs = [(a, b) for a, b in combinations(range(len(units)), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return units, pairs


def test_near_copies_of_paragraphs(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(30, 60)) for _ in range(40)]
    rows = [(i, prose(rng, 25) + "\n" + edited(rng, base[i % 40], 0.03) + f"\nkept{i} " + prose(rng, 6)) for i in range(160)]
    units, pairs = brute_paragraphs(rows, substring.JACCARD)
    lab = components.local_labels(len(units), *(np.array(x) for x in zip(*pairs)))
    gone = {units[k][0] for k in range(len(units)) if lab[k] != k}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in substring.repeats(d).collect()}
    assert len(got & gone) >= 0.9 * len(gone), (len(got & gone), len(gone))
    assert min(got) >= 40
    out = substring.remove_repeats(d).collect()
    assert len(out) == 160 and all(f"kept{r.doc_id} " in r.text for r in out)


def test_repeats_edge_cases(spark):
    rng = random.Random(6)
    t, same = prose(rng, 80), "la " * 300
    rows = [(1, None), (None, t), (2, ""), (3, t), (3, t), (4, t), (5, same), (6, "x " + same), (7, t + "\n" + prose(rng, 30) + "\n" + t), (8, prose(rng, 20_000)), (9, "Les."), (10, "Les.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(7), "n_chars": F.length("text").cast("long"), "key": F.lit("k")})
    got = {r.doc_id for r in substring.repeats(d).collect()}
    assert got == {4, 5, 6, 7}  # 5 repeats within itself
    out = substring.remove_repeats(d)
    assert out.columns == d.columns and out.schema["n_chars"].dataType == d.schema["n_chars"].dataType
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in rows if r.doc_id is not None] == [1, 2, 3, 3, 5, 6, 7, 8, 9, 10]
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    seven = next(r.text for r in rows if r.doc_id == 7)
    assert t not in seven and len(seven.split()) == 30
    assert substring.repeats(d.filter("false")).count() == 0 and substring.remove_repeats(d.filter("false")).count() == 0


# ---- neighbours


def exact(x, k):
    d = neighbours.squared(x, x)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


@pytest.mark.parametrize("n,clusters", [(1500, 12), (300, 300)])
def test_neighbours_recall(spark, n, clusters):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(clusters, 16))
    x = (centers[rng.integers(clusters, size=n)] + 0.6 * rng.normal(size=(n, 16))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    rows = neighbours.nearest(d).collect()
    for r in rows:
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    assert len(got) == n and all(sorted(x[0] for x in v) == list(range(1, 11)) for v in got.values())
    true = exact(x, 10)
    recall = np.mean([len({b for _, b, _ in got[i]} & set(true[i].tolist())) / 10 for i in range(n)])
    assert recall >= 0.9
    r = rows[0]
    assert abs(r.distance - float(np.linalg.norm(x[r.vec_id].astype(float) - x[r.neighbour_id]))) < 1e-6


def test_graph_search_finds_the_nearest():
    x = np.random.default_rng(4).normal(size=(700, 24)).astype(np.float32)
    g = neighbours.Graph(x)
    q = np.random.default_rng(5).normal(size=(300, 24)).astype(np.float32)
    ids, d = g.search(q, 32)
    true = np.argsort(neighbours.squared(q, x), axis=1)[:, :32]
    assert np.mean([len(set(a) & set(b)) / 32 for a, b in zip(ids.tolist(), true.tolist())]) > 0.95 and (np.diff(d, axis=1) >= 0).all()


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [0.0, 0.0]), (8, [None, 1.0]), (9, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).withColumn("v", F.lit(1))
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in neighbours.nearest(d).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert neighbours.nearest(d.filter("false")).count() == 0
    assert neighbours.nearest(d.filter("vec_id = 1")).count() == 0


def test_graph_fills_wide_beams():
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)).astype(np.float32))
    c, q = unit(4000), unit(64)
    ids, d = neighbours.Graph(c).search(q, 1000)
    true = np.argsort(neighbours.squared(q, c), axis=1)[:, :1000]
    assert np.isfinite(d).all() and np.mean([len(np.intersect1d(a, b)) for a, b in zip(ids, true)]) > 980
