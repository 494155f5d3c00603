"""Classifiers on held-out rows, the label model on a known model, mixing against brute force, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchlake.llm import linear, mixing, nbsvm, packing, quality, simhash, substring, toxicity, words as tw
from conftest import SF
from prose import edited, prose

CLEAN = "the of and to in a is that for it".split()


def document(rng, kind):
    w = [rng.choice(CLEAN) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.randint(30, 120))]
    if kind == "low":
        w = [x + rng.choice(["$$$", "###"]) for x in w]
    if kind == "toxic":
        for k in range(0, len(w), 9):
            w[k] = rng.choice(["idiot", "moron", "zugrot", "zugvil", "zugma"])
    return " ".join(w)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    kinds = [rng.choices(["clean", "low", "toxic"], [8, 1, 1])[0] for _ in range(900)]
    rows = [(i, document(rng, k), "en", "s", None) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y string, score double").repartition(4)
    labels = spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kinds) if i % 2], "doc_id long, quality int, toxic int")
    return docs, labels, kinds


ODD = [(None, "no id"), (5001, None), (5002, ""), (5003, "word " * 50_000), (5004, "same"), (5004, "same")]


@pytest.fixture(scope="module")
def odd(spark, world):
    d = spark.createDataFrame([(*r, "en", "s", None) for r in ODD], world[0].schema)
    return world[0].unionAll(d)


def test_nbsvm_held_out(world, odd):
    _, labels, kinds = world
    got = nbsvm.classify(odd, labels).collect()
    assert len(got) == 906 and sum(r.doc_id is None for r in got) == 1
    held = [(kinds[r.doc_id] != "low", r.keep) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    few = nbsvm.classify(odd, labels.filter("false"))
    assert few.filter("not keep").count() == 0 and nbsvm.classify(odd.filter("false"), labels).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    ptr, slot = np.arange(0, 301, 5), np.tile(np.arange(5), 60)
    c = np.full(60, 0.5)
    w = nbsvm.dual_descent(ptr, slot, x.ravel(), y, 5, c, epochs=400, tolerance=1e-7)
    value = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v[:5] + v[5]))).sum()
    for _ in range(300):
        assert value(w) <= value(w + rng.normal(size=6) * 0.05) + 1e-6
    r = nbsvm.log_count_ratio(np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([1.0, -1.0]), 2)
    assert np.allclose(r, [np.log((2 / 4) / (1 / 3)), np.log((2 / 4) / (2 / 3))])


def test_toxicity_held_out(world, odd):
    _, labels, kinds = world
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 906
    held = [(kinds[r.doc_id] == "toxic", r.toxic) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0]
    assert np.mean([b for a, b in held if a]) > 0.95 and np.mean([not b for a, b in held if not a]) > 0.99
    bare = {r.doc_id: r.toxic for r in toxicity.score_toxicity(world[0], labels.filter("false")).collect()}
    assert np.mean([bare[i] for i, k in enumerate(kinds) if k == "toxic"]) > 0.7 and not any(bare[i] for i, k in enumerate(kinds) if k == "clean")
    assert toxicity.score_toxicity(odd.filter("false"), labels).count() == 0


def test_toxicity_of_rare_documents_is_learnt_from_labelled_rows(spark):
    rng = random.Random(6)
    kinds = ["toxic"] * 60 + ["clean"] * 3000
    docs = spark.createDataFrame([(i, document(rng, k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in [*range(30), *range(60, 110)]], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(docs, labels, 80).collect()}
    assert np.mean([got[i] for i in range(30, 60)]) > 0.9 and np.mean([got[i] for i in range(110, 3060)]) < 0.01


def votes_of_known_rates(n, seed=3):
    rng = np.random.default_rng(seed)
    hit = np.array([[0.02, 0.01, 0.01, 0.3, 0.02], [0.6, 0.5, 0.4, 0.3, 0.6]])
    y = (rng.random(n) < 0.1).astype(int)
    m = rng.random((n, 5)) < hit[y]
    m[:, 4] = np.where(rng.random(n) < 0.8, m[:, 0], m[:, 4])  # repeats voter 0
    return y, m, hit


def test_label_model_recovers_rates_without_labels():
    y, m, hit = votes_of_known_rates(40_000)
    bits = m @ (1 << np.arange(5))
    patterns, counts = np.unique(bits, return_counts=True)
    model = toxicity.label_model(patterns, counts, 5, lexical=0b10111)
    assert np.abs(model["rate"][:, :4] - hit[:, :4]).max() < 0.12 and model["correlation"][0, 4] > 0.5
    post = model["posterior"][np.searchsorted(patterns, bits)]
    assert np.mean((post > 0.5) == (y == 1)) > 0.95
    silent = toxicity.label_model(np.array([0, 8]), np.array([10, 5]), 5, lexical=0b10111)
    assert silent["balance"] == 0 and not silent["posterior"].any()


def test_label_model_equals_brute_force():
    """The same EM, document by document and vote by vote."""
    _, m, _ = votes_of_known_rates(300, 9)
    docs, v, lexical = m.astype(int).tolist(), 5, (0, 1, 2, 4)
    share = sum(any(d[j] for j in lexical) for d in docs) / len(docs)
    belief = [0.9 if any(d[j] for j in lexical) else 0.01 for d in docs]
    post = belief
    for _ in range(300):
        rate, corr = [[0.0] * v for _ in range(2)], [[0.0] * v for _ in range(v)]
        for c in (0, 1):
            mean = [(q + b) / 2 for q, b in zip(post, belief)]
            p = [q if c else 1 - q for q in mean]
            mass = sum(p)
            rate[c] = [(sum(q * d[j] for q, d in zip(p, docs)) + 1e-3) / (mass + 2e-3) for j in range(v)]
            cov = [[sum(q * (d[i] - rate[c][i]) * (d[j] - rate[c][j]) for q, d in zip(p, docs)) / max(mass, 1) for j in range(v)] for i in range(v)]
            for i in range(v):
                for j in range(v):
                    if rate[c][i] * mass >= 5 and rate[c][j] * mass >= 5:
                        corr[i][j] = max(corr[i][j], cov[i][j] / (max(cov[i][i], 1e-9) * max(cov[j][j], 1e-9)) ** 0.5)
        corr = [[min(x, 1) if x > 0.05 and i != j else 0 for j, x in enumerate(row)] for i, row in enumerate(corr)]
        tells = []
        for d in docs:
            t = 0.0
            for j in range(v):
                odds = np.log(rate[1][j] / rate[0][j]) if d[j] else np.log((1 - rate[1][j]) / (1 - rate[0][j]))
                t += odds / (1 + sum(corr[j][k] for k in range(v) if d[k] == d[j]))
            tells.append(t)
        low, high = -60.0, 60.0
        for _ in range(60):
            logit = (low + high) / 2
            new = [1 / (1 + np.exp(-max(-40, min(40, t + logit)))) for t in tells]
            low, high = (low, logit) if sum(new) > share * len(docs) else (logit, high)
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        post = new
        if done:
            break
    bits = m @ (1 << np.arange(5))
    patterns, counts = np.unique(bits, return_counts=True)
    got = toxicity.label_model(patterns, counts, 5, lexical=0b10111)["posterior"]
    assert np.allclose(got[np.searchsorted(patterns, bits)], post, atol=1e-4)


def test_voters():
    texts = pa.array(["you idiot", "what an id*ot", "LOOK AT THIS ENORMOUS SHOUTING THING RIGHT NOW OK!! YES!!", "fine", "", "idiot", "zugrot"], pa.large_string())
    v = toxicity.Voters(np.array([tw.word_hash("zugrot")], np.uint64))
    votes = v(texts, tw.words(texts))
    names = [{n.split("_0")[0] if n.startswith("found") else n for k, n in enumerate(toxicity.VOTERS) if x >> k & 1} for x in votes]
    assert names[:6] == [{"insult", "person_insult"}, {"masked"}, {"shouting"}, set(), set(), {"insult"}] and len(names[6]) == 1 and min(names[6]).startswith("found")


def test_rates_meet_targets_and_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 400, 500)
    p = rng.dirichlet([2, 0.5, 0.5], 500)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS)).repartition(3)
    moves, totals, wanted = mixing.solve(table, {"clean": 1.1, "low": 0.6, "toxic": 0.5}, steps=300, tolerance=1e-5)
    assert np.linalg.norm(totals - wanted) < 1e-4 * np.linalg.norm(wanted)
    x, _ = mixing.replay(p, moves)
    assert (x >= 0).all() and np.allclose((n * x) @ p, totals)
    # targets out of reach: the projected optimum, by plain gradient steps on the whole
    moves, totals, wanted = mixing.solve(table, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, steps=400, tolerance=1e-7)
    z = np.ones(500)
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
    for _ in range(20_000):
        z = np.maximum(z - step * p @ ((n * z) @ p - wanted), 0)
    best = np.linalg.norm((n * z) @ p - wanted)
    assert np.linalg.norm(totals - wanted) < 1.02 * best + 1


@pytest.mark.parametrize("share", [(0.8, 0.12, 0.08), (0.85, 0.14, 0.01), (0.9, 0.099, 0.001)])
def test_production_defaults_meet_the_target_of_each_domain(spark, share):
    rng = np.random.default_rng(0)
    y = rng.choice(3, 20_000, p=share)
    n = rng.integers(50, 800, 20_000)
    p = np.stack([rng.dirichlet(0.9 * np.array(share) + 8 * np.eye(3)[c]) for c in y])
    frame = pa.table({"n_tokens": n, **{f"p_{d}": p[:, k] for k, d in enumerate(mixing.DOMAINS)}})
    prices, totals, wanted = mixing.solve(spark.createDataFrame(frame), mixing.TARGETS)
    x, _ = mixing.replay(p, prices)
    assert np.allclose((n * x) @ p, totals)
    assert (np.abs(totals - wanted) <= mixing.TOLERANCE * wanted).all()


def test_production_defaults_out_of_reach(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 400, 500)
    p = rng.dirichlet([2, 0.5, 0.5], 500)
    table = spark.createDataFrame(pa.table({"n_tokens": n, **{f"p_{d}": p[:, k] for k, d in enumerate(mixing.DOMAINS)}}))
    _, totals, wanted = mixing.solve(table, {"clean": 1.0, "low": 0.0, "toxic": 0.0})
    # brute force: out of reach, the optimum is a mixture of two documents
    i, j = np.triu_indices(500, 1)
    aa, ab, bb, aw, bw = (p[i] ** 2).sum(1), (p[i] * p[j]).sum(1), (p[j] ** 2).sum(1), p[i] @ wanted, p[j] @ wanted
    det = aa * bb - ab * ab
    mixed = np.maximum((bb * aw - ab * bw) / det, 0)[:, None] * p[i] + np.maximum((aa * bw - ab * aw) / det, 0)[:, None] * p[j]
    alone = (p @ wanted / (p * p).sum(1))[:, None] * p
    both = np.concatenate([mixed, alone])
    best = both[np.argmin(((both - wanted) ** 2).sum(1))]
    assert np.abs(totals - best).max() <= mixing.TOLERANCE * wanted[0]
    with pytest.raises(RuntimeError, match="did not converge"):
        mixing.solve(table, mixing.TARGETS, steps=1)


def test_mixing_of_documents(world, odd):
    _, labels, kinds = world
    rates = {r.doc_id: r for r in mixing.mixing_rates(odd, labels).collect()}
    assert len(rates) == 905 and rates[5002].rate == 1.0 and rates[5001].n_tokens == 0 and rates[5003].n_tokens == 50_000
    own = {r.doc_id: r.rate for r in mixing.mixing_rates(world[0], labels).collect()}  # without the text that outweighs all
    clean = [own[i] for i, k in enumerate(kinds) if k == "clean"]
    toxic = [own[i] for i, k in enumerate(kinds) if k == "toxic" and i % 2]  # labelled ones
    assert np.mean([x >= 1 for x in clean]) > 0.99 and np.mean(toxic) < 0.5
    out = mixing.mix(odd, labels)
    assert out.columns == odd.columns and out.schema == odd.schema
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i in range(900):
        assert n.get(i, 0) in (int(rates[i].rate), int(rates[i].rate) + 1)
    assert mixing.mix(odd, labels).groupBy("doc_id").count().exceptAll(out.groupBy("doc_id").count()).count() == 0
    assert mixing.mix(odd.filter("false"), labels).count() == 0
    assert mixing.mixing_rates(odd, labels.filter("false")).count() == 906


def test_sample_is_bounded_and_ordered(spark, world):
    d, labels, _ = world
    y = nbsvm.labelled(labels, "quality")
    got = linear.sample(d, y, 100)
    assert got.num_rows == 100 and got.equals(linear.sample(d.repartition(3), y, 100))
    many = spark.range(3000).selectExpr("1L as doc_id", "concat('text ', id % 700) as text")  # one doc_id, ties at the bound
    one = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    assert linear.sample(many, one, 100).num_rows == 100
    few = linear.sample(many, one, 100, most_bytes=50)
    assert 0 < few.num_rows < 9 and sum(map(len, few.column("text").to_pylist())) <= 50
    assert linear.sample(many, one.filter("false"), 100).num_rows == 0


NAMES = ["a b", "c.d", "__row", "__id", "__text", "rate", "n", "x`y"]


def test_columns_of_any_name(spark):
    rng = random.Random(12)
    t = prose(rng, 60)
    rows = [(k, x, *[k] * len(NAMES)) for k, x in enumerate([t, t, edited(rng, t, 0.02), prose(rng, 70) + " " + t, prose(rng, 50), None])]
    rows += [(0, t, *[9] * len(NAMES)), (4, rows[4][1], *[-1] * len(NAMES))]
    d = spark.createDataFrame(rows, ["doc_id", "text", *NAMES])
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.keep_good, simhash.drop_near_duplicates, substring.remove_repeats, lambda x: mixing.mix(x, labels)):
        out = f(d)
        assert out.columns == d.columns and [x.dataType for x in out.schema] == [x.dataType for x in d.schema] and out.count() > 0
        assert f(d.filter("false")).count() == 0
    kept = simhash.drop_near_duplicates(d).filter("doc_id = 4").collect()
    assert [r["a b"] for r in kept] == [-1]  # of repeated rows the least one stays
    for f in (mixing.mixing_rates, nbsvm.classify, toxicity.score_toxicity):
        assert f(d, labels).count() == len(rows)


def test_very_long_texts(spark):
    """Texts of several MB, longer than a slice and a chunk; hashes don't depend on the chunks."""
    rng = random.Random(3)
    some = prose(rng, 20_000)
    long = " ".join([some] * 60) + " " + "x" * 5_000_000
    assert len(long) > 2 * tw.CHUNK
    w = tw.words(pa.array([long], pa.large_string()))
    assert w.hash[7] == tw.word_hash(long.split()[7]) and w.hash[-1] == tw.word_hash("x" * 5_000_000)
    k = int(np.searchsorted(w.start, tw.CHUNK))
    assert all(w.hash[i] == tw.word_hash(long[w.start[i] : w.end[i]]) for i in range(k - 2, k + 2))
    rows = [(1, long), (2, long + " y"), (3, some), (4, "short text of words"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    n = {r.doc_id: r.n_tokens for r in mixing.mixing_rates(d, labels).collect()}
    assert n == {1: 60 * 20_000 + 1, 2: 60 * 20_000 + 2, 3: 20_000, 4: 4, 5: 0}
    assert nbsvm.classify(d, labels).count() == toxicity.score_toxicity(d, labels).count() == 5
    assert {r.doc_id for r in simhash.near_duplicates(d).collect()} >= {2}
    spans = {r.doc_id: (r.start, r.end) for r in substring.repeats(d.filter("doc_id > 1 and doc_id < 5")).collect()}
    assert set(spans) == {2, 3}
    bins = packing.packed_bins(d.filter("doc_id = 1")).collect()
    assert sum(r.n_tokens for r in bins) == 60 * 20_000 + 1


def brute_features(texts):
    """Words and runs of punctuation as they are, and their pairs, by regular expressions."""
    out = []
    for t in texts:
        w = re.findall(r"\w+|[^\w\s]+", t)
        out.append({("u", x) for x in w} | {("b", *x) for x in zip(w, w[1:])})
    return out


def test_nbsvm_equals_brute_force(spark):
    rng = random.Random(5)
    kinds = [rng.random() < 0.6 for _ in range(80)]
    texts = [document(rng, "clean" if k else "low") for k in kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(kinds[i])) for i in range(60)], "doc_id long, quality int")
    sets = brute_features(texts)
    names = sorted(set().union(*sets[:60]))
    x = np.array([[f in s for f in names] for s in sets], float)
    y = np.array([1.0 if k else -1.0 for k in kinds[:60]])
    p, q = 1 + x[:60][y > 0].sum(0), 1 + x[:60][y < 0].sum(0)
    size = 1 << linear.BITS  # smoothing counts every slot
    r = np.log(p / (size - len(names) + p.sum())) - np.log(q / (size - len(names) + q.sum()))
    z = np.column_stack([x * r / np.sqrt([[len(s)] for s in sets]), np.ones(len(texts))])
    c = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    a = np.zeros(60)
    gram = (z[:60] @ z[:60].T) * np.outer(y, y)
    for _ in range(4000):  # projected gradient on the dual
        a = np.clip(a - (gram @ a - 1) / np.linalg.eigvalsh(gram).max(), 0, c)
    want = z @ (z[:60].T @ (a * y))
    got = {g.doc_id: g.score for g in nbsvm.classify(docs, labels).collect()}
    got = np.array([got[i] for i in range(80)])
    assert np.corrcoef(got[:60], want[:60])[0, 1] > 0.999 and np.mean((got > 0) == (want > 0)) > 0.97 and np.abs(got[:60] - want[:60]).max() < 0.1


def test_mixing_rates_equal_brute_force(spark, world):
    """Posteriors by dictionaries from the fitted weights, rates by the dual on all documents at once."""
    docs, labels, _ = world
    model = mixing.domain_model(docs, labels, linear.FIT_ROWS)
    weight = dict(zip(model.slots.tolist(), model.weight.astype(float)))
    rows = {r.doc_id: r for r in mixing.mixing_rates(docs, labels).collect()}
    ids, p, n = sorted(rows), [], []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in ids:
        w = tw.words(pa.array([texts[i]], pa.large_string()), lower=False, inside=tw.PUNCTUATED)
        slots = {int(h) >> (64 - linear.WIDE_BITS) for _, hs in linear.each(w, model.kinds) for h in hs}
        hits = [weight[s] for s in slots if s in weight]
        z = model.bias + sum(hits) / max(len(hits), 1) ** 0.5
        e = np.exp(z - z.max())
        p.append(e / e.sum())
        n.append(len(texts[i].split()))
    p, n = np.array(p), np.array(n, float)
    assert np.allclose(p, [[rows[i][f"p_{d}"] for d in mixing.DOMAINS] for i in ids], atol=1e-5) and [rows[i].n_tokens for i in ids] == n.tolist()
    wanted = (n @ p) * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    rate = np.array([rows[i].rate for i in ids])
    assert (np.abs((n * rate) @ p - wanted) <= 2e-3 * wanted).all()
    price = np.zeros(3)
    for _ in range(500):  # of all rates that meet the targets, the ones nearest to 1
        x = np.maximum(1 - p @ price, 0)
        g = (p * (n * (x > 0))[:, None]).T @ p
        price = price + 0.5 * np.linalg.solve(g + 1e-9 * np.eye(3) * np.trace(g), (n * x) @ p - wanted)
    x = np.maximum(1 - p @ price, 0)
    assert np.abs((n * x) @ p - wanted).max() < 1e-3 * wanted.min() and np.abs(rate - x).max() < 0.02


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "source mixing", "harmonic packing"]
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(60)]
    passage = prose(rng, 70)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, base[i], 0.03), "en", "s", 1) for i in range(20)]
    rows += [(200 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60), "en", "s", 1) for i in range(6)]
    rows += [(300, "$$$ ### $$$ ### a$$$ b###", "en", "s", 1), (301, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
    rules, near, repeats, mixed, bins = seen
    assert {r.doc_id for r in rules} == {r[0] for r in rows} - {300, 301}
    assert {r.doc_id for r in near} == {r.doc_id for r in rules} - set(range(100, 120))
    assert sum(passage in r.text for r in repeats) == 1 and {r.doc_id for r in repeats} == {r.doc_id for r in near}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in repeats}
    assert sum(r.n_docs for r in bins) == len(mixed) and max(r.n_tokens for r in bins) <= packing.CAPACITY
    for k in range(3):
        assert set(seen[k + 1][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} or k == 2


def brute_pipeline(docs, labels, spark):
    """The stages by loops over all documents and pairs, but for the fitted posteriors of the mixing stage."""
    good = []
    for i, t, *rest in docs:
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.strip()]
        symbols = sum((t or "").count(c) for c in "#$%&*@^~<>{}=+")
        repeats = sum(a == b for a, b in zip(w, w[1:]))
        if w and not (len(w) >= 5 and symbols / len(w) > 0.3) and not (len(w) >= 10 and repeats / len(w) > 0.2) and not (len(lines) >= 8 and (len(lines) - len(set(lines))) / len(lines) > 0.6):
            good.append((i, t, *rest))
    w = tw.words(pa.array([r[1] for r in good], pa.large_string()))
    _, s = simhash.sketch(w)
    leader = list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            bits = [int(x ^ y).bit_count() for x, y in zip(s[a].tolist(), s[b].tolist())]
            if bits[0] <= 11 and sum(bits) <= 38:
                old, new = max(leader[a], leader[b]), min(leader[a], leader[b])
                leader = [new if x == old else x for x in leader]
    return [r for r in good], [r for k, r in enumerate(good) if leader[k] == k]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(14)
    passage, rows = prose(rng, 80), []
    for i in range(40):
        rows.append((i, prose(rng, 120), "en", "s", 1))
    rows += [(100 + i, edited(rng, rows[i][1], 0.02), "en", "s", 1) for i in range(10)] + [(120 + i, rows[i][1], "fr", "t", 2) for i in range(5)]
    rows += [(200 + i, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60), "en", "s", 1) for i in range(5)]
    rows += [(300, "$$$ ### $$$ ### a$$$", "en", "s", 1), (301, None, "en", "s", None), (302, "la " * 50, "en", "s", 1), (303, "one line\n" * 12, "en", "s", 1), (304, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good, kept = brute_pipeline(rows, labels, spark)
    first = min(i for i, t, *_ in kept if passage in t)
    cut = {i: (t if passage not in t or i == first else t.replace("\n" + passage + "\n", "\n\n")) for i, t, *_ in kept}
    got = docs
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality rules", "near duplicates", "repeated passages"):
        got = stages[name](spark, got, str(tmp_path))
        if name == "quality rules":
            assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in good)
        if name == "near duplicates":
            assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in kept)
    assert {r.doc_id: r.text for r in got.collect()} == cut
    # labels name one domain only, so every document has the rate that meets its target
    mixed = stages["source mixing"](spark, got, str(tmp_path)).collect()
    n = {i: sum(r.doc_id == i for r in mixed) for i in cut}
    assert set(n.values()) <= {1, 2} and abs(sum(n.values()) / len(n) - mixing.TARGETS["clean"]) < 0.25
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    back = sorted(x for r in bins for x in zip(r.doc_ids, r.text.split("\f")))
    assert back == sorted((r.doc_id, r.text) for r in mixed)
    full = {}
    for i, t in back:
        size = len(t.split())
        full[min(packing.CAPACITY // size, packing.CLASSES)] = full.get(min(packing.CAPACITY // size, packing.CLASSES), 0) + 1
    assert len(bins) == sum(-(-m // k) for k, m in full.items())


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["shard", "class", "bin", "n_docs", "n_tokens", "doc_ids", "starts", "text"] and out.count() > 0
