import random
import statistics

import pytest
from pyspark.sql import functions as F

from batchlake.operators import batches
from batchlake.operators.rowindex import with_row_index
from batchlake.operators.samples import SampleSet


def simulate(size, batch, epoch, start, early=False):
    """The rule of the loop, as it is said: rows of each batch, k, and the next start."""
    out, done = [], 0
    while done < epoch:
        stop = min(start + batch - 1, size, start + epoch - done - 1)
        rows = list(range(start, stop + 1))
        done += len(rows)
        out.append((rows, done))
        start = stop + 1
        if start >= size + (0 if early else 1):
            start = 1
    return out, start


@pytest.mark.parametrize("wrap", ["base", "early"])
@pytest.mark.parametrize("size,batch,epoch,start", [(5, 2, 6, 1), (5, 2, 13, 4), (3, 8, 10, 2), (100, 32, 100, 45), (1, 1, 3, 1), (10, 3, 4, 10), (7, 7, 20, 1), (9, 4, 1, 9)])
def test_sequential_equals_loop(spark, wrap, size, batch, epoch, start):
    if wrap == "early" and size == 1:
        pytest.skip("a set of one row has no early wrap")
    want, after = simulate(size, batch, epoch, start, wrap == "early")
    rows = batches.sequential(spark, size, batch, epoch, start, wrap).orderBy("g").collect()
    got = {}
    for r in rows:
        got.setdefault((r.batch, r.k), []).append(r._idx)
    assert [(v, k) for (_, k), v in sorted(got.items(), key=lambda x: x[0][1])] == want
    assert len({b for b, _ in got}) == len(want)
    assert batches.next_cursor(start, epoch, size, wrap, batch) == after


def test_five_row_example(spark):
    s = SampleSet.of(spark.createDataFrame([(float(i), float(i)) for i in range(1, 6)], "x double, y double"), ["x"], ["x"], ["y"])
    got = batches.as_batches(s.sequential_batches(2, 6), ["x"]).orderBy("k").collect()
    assert [r.k for r in got] == [2, 4, 5, 6]
    assert [[x.x for x in r.rows] for r in got] == [[1, 2], [3, 4], [5], [1]]
    assert s.cursor.start == 2
    s.reset()
    assert s.cursor.start == 1


def test_random_batches_are_spread(spark):
    rows = batches.random(spark, 100, 24, 24_000, "a").collect()
    counts = [0] * 101
    for r in rows:
        counts[r._idx] += 1
    assert min(counts[1:]) > 0 and 10 < statistics.pstdev(counts[1:]) < 22
    assert rows[-1].k == 24_000 and {r.k for r in batches.random(spark, 10, 4, 10, "a").collect()} == {4, 8, 10}


def test_sample_set_algebra(spark):
    d = spark.createDataFrame([(i, [float(i)] * 3, ([[float(i)] * 2], float(-i))) for i in range(100)], "id long, x array<double>, y struct<_1:array<array<double>>,_2:double>")
    s = SampleSet.of(d, ["id"], ["x"], ["y"])
    assert s.size() == 100 and s.shape_of(["x"]) == [[3]] and s.shape_of(["x"], True) == [[100, 3]]
    assert [r.id for r in s.take_list([5, 1, 5]).collect()] == [4, 0, 4]
    assert [r.id for r in s.between(3, 4).orderBy("_idx").collect()] == [2, 3]
    a, b = s.cut(0.2)
    assert (a.size(), b.size()) == (20, 80) and b.df.agg(F.min("_idx"), F.max("_idx"), F.min("id")).first() == (1, 80, 20)
    p = s.permute("q")
    moved = p.df.collect()
    assert sorted(r.id for r in moved) == list(range(100)) and sorted(r._idx for r in moved) == list(range(1, 101))
    assert any(r._idx != r._was for r in moved) and all(r.y["_2"] == -r.id for r in moved)
    assert s.draw(50, "z").count() == 50
    with pytest.raises(ValueError):
        s.cut(1.0)


def test_cut_sizes_of_the_image_sets(spark):
    s = SampleSet(spark.range(1, 2).withColumnRenamed("id", "_idx"), [], [])
    for n, want in ((50000, 41666), (60000, 50000)):
        s._size = n
        assert s.cut(1 - 1 / 6)[0].size() == want


def test_row_index_in_parts_equals_one_part(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(500)] + [(None, 1000)]
    d = spark.createDataFrame(rows, "a int, b long").repartition(7)
    one, many = (with_row_index(d, ["a", "b"], parts=p).orderBy("_idx").collect() for p in (1, 7))
    assert one == many and [r._idx for r in many] == list(range(1, 502))
    assert with_row_index(d.filter("false"), ["a", "b"], parts=7).count() == 0


def test_prefetched(spark):
    d = batches.sequential(spark, 10, 3).groupBy("batch").count()
    assert [r["count"] for r in batches.prefetched(d)] == [3, 3, 3, 1]
