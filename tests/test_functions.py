import pytest
from pyspark.sql import functions as F

from batchlake.functions import images, numeric, tweets, vocab
from batchlake.operators.rowindex import with_row_index


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tokens_and_parts(spark):
    assert one(spark, vocab.tokens(F.lit(" a  b\tc\n"))) == ["a", "b", "c"]
    assert one(spark, vocab.split_chars(F.lit("a:b-c]d^e\\f::"), ":-]^\\")) == ["a", "b", "c", "d", "e", "f"]
    assert one(spark, vocab.lines_to_words(F.lit("a b\nc\n"))) == ["a", "b", "<eos>", "c", "<eos>"]
    assert one(spark, vocab.lines_to_words(F.lit(" a \n b \n"), compat=True)) == ["a", "<eos>", "b", "<eos>"]
    assert one(spark, vocab.field(F.lit('"4","1","day","q","me","hi, there ""you"""'), 6)) == "hi"


def words(spark, text):
    return spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "pos long, word string")


def test_vocabularies(spark):
    f = vocab.frequency(words(spark, "b a a c b a <OOV>"))
    last = {r.word: (r.id, r.freq) for r in vocab.vocabulary(f, 2).collect()}
    assert last == {"a": (1, 3), "b": (2, 2), "<OOV>": (3, 2)}
    whole = {r.word: r.id for r in vocab.vocabulary(vocab.frequency(words(spark, "b a")), 1).collect()}
    assert whole == {"a": 1, "b": 2}
    first = {r.word: (r.id, r.freq) for r in vocab.vocabulary(vocab.frequency(words(spark, "b a")), 1, "first").collect()}
    assert first == {"a": (2, 1), "b": (3, 1), "<OOV>": (1, 0)}


def test_encode_pad_decode(spark):
    v = vocab.vocabulary(vocab.frequency(words(spark, "b a a c b a")), 2)
    e = vocab.encode(words(spark, "a zz b").withColumn("k", F.lit(1)), v)
    s = vocab.sequences(e, ["k"])
    assert s.first().ids == [1, 3, 2]
    p = s.select("k", vocab.padded("ids", 5).alias("ids"))
    assert p.first().ids == [0, 0, 1, 3, 2] and s.select(vocab.padded("ids", 2).alias("x")).first().x == [1, 3]
    assert vocab.decode(p, ["k"], "ids", v).first().text == "a <OOV> b"
    full = vocab.vocabulary(vocab.frequency(words(spark, "a")))
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.encode(words(spark, "q"), full).collect()


def test_bigrams(spark):
    m = vocab.bigrams(spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1)], "cur long, next long"))
    assert {(r.cur, r.next): (r.freq, round(r.prob, 3)) for r in m.collect()} == {(1, 2): (2, 0.667), (1, 3): (1, 0.333), (2, 1): (1, 1.0)}
    assert vocab.bigram_lists(m).count() == 2


def test_polarity(spark):
    d = spark.createDataFrame([(0,), (2,), (4,)], "p int").select(vocab.polarity("p").alias("y"))
    assert [r.y for r in d.collect()] == [1, None, 2]
    with pytest.raises(Exception, match="unknown polarity"):
        one(spark, vocab.polarity(F.lit(3)))


def test_rescale_and_binarize(spark):
    x = F.array(F.lit(0.0), F.lit(127.5), F.lit(255.0))
    assert one(spark, numeric.rescale(x, 0, 1, 0.0, 255.0)) == pytest.approx([0, 0.5, 1])
    assert one(spark, numeric.binarize(x, 100)) == [0, 1, 1]
    assert one(spark, numeric.binarize(x, -1)) == [1, 1, 1] and one(spark, numeric.binarize(x, 0)) == [1, 1, 1]


def test_normalization(spark):
    d = spark.range(100).select((F.col("id") + 1).alias("_idx"), F.array(F.col("id") % 7 + 0.0, F.col("id") % 7 + 1.0, F.col("id") * 2.0, F.col("id") * 3.0).alias("x"))
    s = numeric.channel_stats(d, "x", 2)
    back = numeric.normalizer(s)(d, "x")
    again = {r.channel: r for r in numeric.channel_stats(back, "x", 2).collect()}
    assert all(abs(r["mean"]) < 1e-9 and abs(r["std"] - 1) < 1e-9 for r in again.values())
    plain, compat = ({r.channel: r["mean"] for r in numeric.channel_stats(d, "x", 2, compat=c).collect()} for c in (False, True))
    assert compat[0] == pytest.approx(plain[0] * 4 * 32 / 100)


def test_images(spark):
    d = spark.createDataFrame([(1, [float(i) for i in range(32)])], "id long, x array<double>")
    shape = (2, 4, 4)
    assert d.select(images.crop("x", shape, 1, 2, (2, 2)).alias("x")).first().x == [6, 7, 10, 11, 22, 23, 26, 27]
    assert d.select(images.flip_horizontal("x", shape).alias("x")).first().x[:4] == [3, 2, 1, 0]
    ten = images.ten_crop(d, "x", shape, (3, 3)).orderBy("view").collect()
    assert len(ten) == 10 and ten[2].x[:3] == [0, 1, 2] and ten[3].x[:3] == [2, 1, 0] and images.center((1, 5, 5), (2, 2)) == (2, 2)
    r = images.random_crop(d, "x", shape, (2, 2), "id", "s").first().x
    assert len(r) == 8 and r == images.random_crop(d, "x", shape, (2, 2), "id", "s").first().x
    assert d.select(images.resize_nearest("x", shape, (2, 2)).alias("x")).first().x == [0, 2, 8, 10, 16, 18, 24, 26]
    assert images.target_size((128, 128), (96, 96), (64, 64)) == (48, 48) and images.smallest_side((32, 64), 16) == (16, 32)


@pytest.mark.parametrize(
    "text,want",
    [
        ("hello   world", ["hello", "world"]),
        ("I can't, won't!", ["I", "ca", "n't", ",", "wo", "n't", "!"]),
        ("see http://t.co/ab?x=1 now", ["see", "http://t.co/ab?x=1", "now"]),
        ("mail me@host.org ok", ["mail", "me@host.org", "ok"]),
        ("#tag @you :) <3", ["#tag", "@you", ":)", "<3"]),
        ("at 12:30 for $9.99, 1,000 times", ["at", "12:30", "for", "$9.99", ",", "1,000", "times"]),
        ("wait...what?!", ["wait", "...", "what", "?!"]),
        ("Mr. Smith's U.S. \"dream\"", ["Mr.", "Smith", "'s", "U.S.", '"', "dream", '"']),
        ("für alle", ["für", "alle"]),
        ("a -> b &amp; c", ["a", "->", "b", "&amp;", "c"]),
        ("rock-n-roll's", ["rock-n-roll", "'s"]),
        ("", []),
    ],
)
def test_message_tokens(spark, text, want):
    assert one(spark, tweets.tokenize(F.lit(text))) == want


def test_message_tokens_of_null(spark):
    assert one(spark, tweets.tokenize(F.lit(None).cast("string"))) is None


def test_index_of_words(spark):
    d = with_row_index(vocab.exploded(spark.createDataFrame([(2, "c d"), (1, "a b")], "k long, t string"), ["k"], "t"), ["k", "pos"])
    assert [r.word for r in d.orderBy("_idx").collect()] == ["a", "b", "c", "d"]


def test_word_stream(spark):
    texts = {k: " ".join(f"w{k}_{i}" for i in range(k % 4)) for k in range(60)} | {3: None, 9: " \n ", 20: "été x"}
    d = spark.createDataFrame([(k, t) for k, t in reversed(texts.items())], "k long, t string").repartition(5)
    got, size = vocab.word_stream(d, ["k"], "t")
    rows = sorted((r._idx, r.word, r.following) for r in got.collect())
    words = [w for k in sorted(texts) for w in (texts[k] or "").split()]
    assert size == len(words) and rows == [(i + 1, w, n) for i, (w, n) in enumerate(zip(words, [*words[1:], None]))]
    none, size = vocab.word_stream(d.filter("false"), ["k"], "t")
    assert size == 0 and none.count() == 0


def test_vocabulary_ranks_bytes(spark):
    words = ["a", "aa", "ab", "abc", "b", "é", "中", "Z", "<OOV>", "z", "rare"]
    f = spark.createDataFrame([(w, 1 if w == "rare" else 5) for w in words], "word string, freq long")
    got = {r.word: r.id for r in vocab.vocabulary(f, 2).collect()}
    kept = sorted((w for w in words if w not in ("<OOV>", "rare")), key=lambda w: w.encode())
    assert got == {w: i for i, w in enumerate(kept, 1)} | {"<OOV>": len(kept) + 1}


def test_texts_without_words_are_encoded(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None)], "k long, t string")
    v = vocab.vocabulary(vocab.frequency(vocab.exploded(d, ["k"], "t")), 2)
    s = vocab.sequences(vocab.encode(vocab.exploded(d, ["k"], "t", outer=True), v), ["k"])
    assert {r.k: r.ids for r in s.collect()} == {1: [1, 1, 2], 2: [], 3: []}
    assert {r.k: r.text for r in vocab.decode(s, ["k"], "ids", v).collect()} == {1: "a a <OOV>", 2: "", 3: ""}


def test_blocks_of_texts():
    import pyarrow as pa

    from batchlake.functions import lookup

    texts = ["a  b\tc", None, "", " \n ", "été 中\x0bx\ra", "b", "c\x00d"] * 3
    words, at = lookup.split(pa.array(["zz", *texts]).slice(1))  # a slice of a larger array
    want = [[w for w in __import__("re").split(vocab.SPACE, t or "") if w] for t in texts]
    assert [words.to_pylist()[i:j] for i, j in zip(at, at[1:])] == want
    known = sorted({w for t in want for w in t}, reverse=True)
    table = pa.table({"word": known, "id": pa.array(range(7, 7 + len(known)), pa.int64())})
    number = dict(zip(known, range(7, 7 + len(known))))
    ids = lookup.text_ids(pa.array(texts), table)
    assert ids.to_pylist() == [[number[w] for w in t] for t in want]
    assert lookup.text_ids(pa.array(texts), table, 2).to_pylist() == [[number[w] for w in t[:2]] for t in want]
    assert lookup.id_texts(ids, table).to_pylist() == [" ".join(t) for t in want]
    assert lookup.id_texts(pa.array([None, [0, 7, 99], []], pa.list_(pa.int64())), table).to_pylist() == ["", known[0], ""]


def test_texts_meet_the_vocabulary_by_block(spark, monkeypatch):
    """encode_texts() and decode() look up each distinct word or id of a block once, not each place; also in slices."""
    from batchlake.functions import lookup

    monkeypatch.setattr(lookup, "SLICE_BYTES", 40)
    d = spark.createDataFrame([(k, " ".join(["a", "b", "été", f"w{k}"] * (k % 5))) for k in range(40)], "k long, t string")
    v = vocab.vocabulary(vocab.frequency(vocab.exploded(d, ["k"], "t")), 3)
    e = vocab.encode_texts(d, ["k"], "t", v, blocks=3)
    old = vocab.sequences(vocab.encode(vocab.exploded(d, ["k"], "t", outer=True), v), ["k"])
    assert sorted(e.collect()) == sorted(old.collect())
    back = vocab.decode(e, ["k"], "ids", v, 3)
    assert {r.k: r.text for r in back.collect()} == {k: " ".join(["a", "b", "été", f"w{k}" if k % 5 > 2 else "<OOV>"] * (k % 5)) for k in range(40)}
    plan = vocab.decode(old, ["k"], "ids", v)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode_outer(ids" not in plan.lower().replace(" ", "") and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("columns", [1, 3, 500])
def test_bigrams_of_texts(spark, columns):
    """Pairs across texts and blocks, none across columns, as folding word by word gives."""
    texts = {k: " ".join(f"w{(k * i) % 3}" for i in range(k % 4)) for k in range(60)} | {3: None, 9: " \n "}
    d = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(5)
    words = [w for k in sorted(texts) for w in (texts[k] or "").split()]
    v = vocab.vocabulary(vocab.frequency(vocab.exploded(d, ["k"], "t")), 2)
    ids, s = {r.word: r.id for r in v.collect()}, len(words) // columns
    want = {}
    for i in range(s * columns - 1):
        if i % s < s - 1:
            pair = ids.get(words[i], ids.get("<OOV>")), ids.get(words[i + 1], ids.get("<OOV>"))
            want[pair] = want.get(pair, 0) + 1
    m = vocab.text_bigrams(d, ["k"], "t", v, columns)
    assert {(r.cur, r.next): r.freq for r in m.collect()} == want
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
