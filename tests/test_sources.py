import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from batchlake.sources import catalog, connectors
from batchlake.streaming import feeds


@pytest.fixture
def folders(tmp_path):
    for c in range(1, 12):
        for i in range(4):
            f = tmp_path / "img" / f"class{c}" / f"{i}.JPG"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"x")
    (tmp_path / "img" / "class1" / "ignore").mkdir()
    (tmp_path / "img" / "class1" / "ignore" / "z.jpg").write_bytes(b"x")
    (tmp_path / "img" / "class2" / "note.txt").write_bytes(b"x")
    (tmp_path / "img" / "class2" / "skip_1.png").write_bytes(b"x")
    (tmp_path / "img" / ".hidden").mkdir()
    (tmp_path / "img" / ".hidden" / "h.jpg").write_bytes(b"x")
    return str(tmp_path / "img")


def test_image_folders(spark, folders):
    d, c = catalog.image_folders(spark, [folders], exclude_file="SKIP*", exclude_dir="*/ignore/*", content=False)
    assert d.count() == 44 and [r.class_name for r in c.orderBy("class_id").collect()][:3] == ["class1", "class10", "class11"]
    assert sorted(r._idx for r in d.collect()) == list(range(1, 45))
    n, c = catalog.image_folders(spark, [folders], content=True, sort_by_number=True)
    assert n.count() == 46 and [r.class_name for r in c.orderBy("class_id").collect()][1] == "class2" and "content" in n.columns
    both, c = catalog.image_folders(spark, [folders, folders], content=False)
    assert both.count() == 92 and c.count() == 11
    drawn = catalog.balanced_draw(n, catalog.class_table(n, "class_name"), 100, "s")
    assert drawn.count() == 100
    with pytest.raises(ValueError, match="without an image"):
        catalog.image_folders(spark, [folders], exclude_dir="*/class3/*", content=False)


def test_frames(spark):
    paths = [f"/d/{s}/{r}{t}.jpg" for s, n in (("a", 3), ("b", 12)) for t in range(1, n + 1) for r in ("input", "target")] + ["/d/a/input7.jpg", "/d/c/note.jpg"]
    f, index = catalog.frame_sequences(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.name: r.frames for r in index.collect()} == {"a": 3, "b": 12}
    assert [r.target for r in f.filter("seq = 2").orderBy("t").collect()][9] == "/d/b/target10.jpg"
    other, i2 = catalog.frame_sequences(spark.createDataFrame([("/d/a/x1.png",), ("/d/a/y1.png",)], "path string"), r"x(\d+)\.", r"y(\d+)\.")
    assert other.first().input == "/d/a/x1.png" and i2.count() == 1


def test_positional_join_and_rename(spark):
    a, b = spark.createDataFrame([("f2",), ("f1",), ("f3",)], "f string"), spark.createDataFrame([(1, "x"), (2, "y")], "n int, c string")
    assert [(r.f, r.c) for r in catalog.positional_join(a, ["f"], b, ["n"]).orderBy("_idx").collect()] == [("f1", "x"), ("f2", "y")]
    plan = catalog.rename_plan(spark.createDataFrame([("d1", "k1"), ("d2", "none")], "src string, k string"), spark.createDataFrame([("k1", 5)], "k string, id int"), "k", "id")
    assert plan.collect() == [("d1", "5")]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "train.txt").write_text("the cat\nthe dog\n")
    (tmp_path / "test.txt").write_text("the cow\n")
    sets, v = connectors.text_corpus(spark, str(tmp_path / "train.txt"), {"test": str(tmp_path / "test.txt")}, min_freq=2)
    ids = {r.word: r.id for r in v.collect()}
    assert ids == {"<eos>": 1, "the": 2, "<OOV>": 3}
    assert [r.id for r in sets["train"].orderBy("_idx").collect()] == [2, 3, 1, 2, 3, 1]
    assert [r.id for r in sets["test"].orderBy("_idx").collect()] == [2, 3, 1]
    assert connectors.line_count(spark, str(tmp_path / "train.txt")) == 2


def test_sentences(spark):
    rows = [(1, 10, 5), (2, 10, 793471), (3, 20, 793471), (4, 10, 7), (5, 10, 793471)]
    d = spark.createDataFrame(rows, "pos long, start_id long, word_id long")
    assert [r["values"] for r in connectors.sentences(d).orderBy("seq").collect()] == [[793470, 5, 793471], [793470, 793471], [793470, 7, 793471]]
    with pytest.raises(Exception, match="no end in sentence"):
        connectors.sentences(d.filter("pos < 2")).collect()


def test_messages(spark, tmp_path):
    lines = ['"0","1","d","q","u","bad bad day , cut here"', '"2","2","d","q","u","so so day"', '"4","3","d","q","u","good day"', '"0","4","d"']
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    m = connectors.message_lines(spark, str(tmp_path / "m.csv"))
    assert sorted((r.polarity, r.text) for r in m.collect()) == [(0, "bad bad day "), (2, "so so day"), (4, "good day")]
    s, v = connectors.encoded_messages(m, min_freq=2, length=4)
    ids = {r.word: r.id for r in v.collect()}
    assert ids == {"<OOV>": 1, "bad": 2, "day": 3, "so": 4}
    assert sorted((r.target, r.ids) for r in s.df.collect()) == [(1, [0, 2, 2, 3]), (2, [0, 0, 1, 3])]
    st = connectors.message_statistics(m, v, 2).first()
    assert (st.n_messages, st.n_tokens, st.vocabulary, st.oov_tokens) == (3, 8, 4, 1)
    clean = connectors.message_lines(spark, str(tmp_path / "m.csv"), clean=True)
    assert "bad bad day , cut here" in [r.text for r in clean.collect()]
    connectors.write_tokenized(clean.filter("text is not null"), str(tmp_path / "out"))
    assert any('"bad bad day , cut here"' in f.read_text() for f in (tmp_path / "out").glob("part*"))


def test_image_set(spark):
    parts = [spark.createDataFrame([(p * 10 + i, [float(i), 10.0], i % 3) for i in range(10)], "id long, pixels array<double>, label int") for p in range(3)]
    train, valid = connectors.image_set(parts, shape=(1, 1, 2))
    assert (train.size(), valid.size()) == (25, 5) and train.shape_of(["pixels"]) == [[1, 1, 2]]
    r = train.df.agg(F.min("label"), F.max("label"), F.max(F.array_max("pixels")), F.min(F.array_min("pixels"))).first()
    assert tuple(r) == (1, 3, 1.0, 0.0)


def test_cache_and_loading(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert connectors.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1
    assert connectors.cached(spark, str(tmp_path / "c"), make, overwrite=True).count() == 3 and len(made) == 2
    assert connectors.load_any(spark, str(tmp_path / "c")).count() == 3
    with pytest.raises(ValueError):
        connectors.load_any(spark, str(tmp_path / "nothing"))


def test_archives_and_helpers(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.txt", "x")
    with gzip.open(tmp_path / "b.gz", "wb") as f:
        f.write(b"y")
    out = connectors.unpack(str(tmp_path / "a.zip"), str(tmp_path / "o"))
    connectors.unpack(str(tmp_path / "b.gz"), out)
    assert (tmp_path / "o" / "in.txt").read_text() == "x" and (tmp_path / "o" / "b").read_text() == "y"
    with pytest.raises(ValueError):
        connectors.unpack("x.zipper", out)
    assert connectors.fetch(str(tmp_path / "b.gz"), str(tmp_path / "p")).endswith("b.gz")
    with pytest.raises(ValueError):
        connectors.fetch("http://x/y", out)
    assert connectors.unique_id("n").startswith("n:") and connectors.unique_id("n") != connectors.unique_id("n")
    assert connectors.run_in(str(tmp_path), lambda: __import__("os").getcwd()) == str(tmp_path)
    monkeypatch.setenv("BATCHLAKE_DATA", str(tmp_path / "d"))
    assert connectors.Paths.from_env(make=True).data == str(tmp_path / "d")


def test_stream_feed(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    q = feeds.feed(feeds.file_stream(spark, str(tmp_path / "in"), schema), ["id"], 4, lambda d, n: seen.append((n, d.count(), d.agg(F.max("batch")).first()[0])), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == [(0, 10, 2), (1, 10, 2), (2, 10, 2)]
