import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchlake.operators import layouts
from batchlake.operators.rowindex import with_row_index


def test_fold_of_1003(spark):
    d = spark.range(1, 1004).selectExpr("id as _idx", "id * 10 as value")
    f, s = layouts.fold(d, 50)
    assert s == 20 and f.count() == 1000 and layouts.fold_size(s) == 19
    rows = {(r.lane, r.t): r for r in layouts.next_targets(f, "value").collect()}
    assert len(rows) == 50 * 19 and rows[(3, 5)].value == (3 * 20 + 5 + 1) * 10 and rows[(3, 5)].target == rows[(3, 5)].value + 10
    assert layouts.next_targets(f, "value", True).filter("value = target").count() == 1000
    assert layouts.fold(d.limit(3), 5)[1] == 0


def lanes_of(runs, columns, steps):
    lanes = [[None] * steps for _ in range(columns)]
    for c, t, n, seq, off, mask in runs:
        for j in range(n):
            assert lanes[c][t + j] is None
            lanes[c][t + j] = "M" if mask else (seq, off + j)
    assert all(x is not None for lane in lanes for x in lane)
    return lanes


@pytest.mark.parametrize("columns,chunk", [(1, 15), (8, 15), (4, 1), (3, 1000)])
def test_packing_invariants(columns, chunk):
    rng = random.Random(1)
    slots = [rng.randint(1, 20) for _ in range(200)]
    steps = layouts.packed_size(sum(slots), columns)
    runs, _ = layouts.plan_pack(slots, columns, chunk, steps)
    for lane in lanes_of(runs, columns, steps):
        assert lane[0] == "M"
        at = [i for i, x in enumerate(lane) if x == "M"]
        for a, b in zip(at, at[1:]):
            run = lane[a + 1 : b]
            if run:
                assert run == [(run[0][0], j) for j in range(slots[run[0][0] - 1] - 1)]
    masks = sum(r[5] for r in runs)
    assert 200 <= masks <= 200 + columns


def test_one_column_is_the_running_sum():
    slots = [3, 1, 5, 2]
    runs, _ = layouts.plan_pack(slots, 1, 4, sum(slots))
    assert [r[1] for r in runs if r[5]] == [0, 3, 4, 9]


def test_packing_resumes():
    slots = [4, 7, 2, 9, 5]
    whole, end = layouts.plan_pack(slots, 3, 5, 20)
    first, state = layouts.plan_pack(slots, 3, 5, 10)
    second, end2 = layouts.plan_pack(slots, 3, 5, 10, state)
    assert whole == first + [(c, t + 10, *rest) for c, t, *rest in second] and end == end2


def test_pack_columns_frame(spark):
    values = {1: [5, 6, 7], 2: [8], 3: [9, 10]}
    d = spark.createDataFrame([(k, v) for k, v in values.items()], "seq long, values array<long>")
    rows, _ = layouts.pack_columns(d, 1, 6)
    assert [(r.input, r.target, r.is_mask) for r in rows.orderBy("t").collect()] == [(0, 1, True), (5, 6, False), (6, 7, False), (0, 1, True), (0, 1, True), (9, 10, False)]
    rows, _ = layouts.pack_columns(d, 1, 9, shifted=False)
    assert [(r.input, r.target) for r in rows.orderBy("t").collect()] == [(0, 0), (5, 5), (6, 6), (7, 7), (0, 0), (8, 8), (0, 0), (9, 9), (10, 10)]
    rows, _ = layouts.pack_columns(d, 2, 3, steps=6, seed=4)
    assert rows.count() == 12


def test_single_column(spark):
    d = spark.createDataFrame([(1, 3), (2, 1), (3, 5)], "seq long, n long")
    assert [r.t for r in layouts.single_column(d).orderBy("seq").collect()] == [0, 3, 4]


def test_row_index_name(spark):
    assert with_row_index(spark.range(3), ["id"], "seq").columns == ["id", "seq"]


def test_targets_across_blocks(spark):
    d = spark.range(1, 1004).selectExpr("id as _idx", "if(id % 7 = 0, null, id * 10) as value")
    f, _ = layouts.fold(d, 50)
    whole, cut = (sorted((r.lane, r.t, r.value or 0, r.target or 0) for r in layouts.next_targets(f, "value", block=b).collect()) for b in (1 << 18, 16))
    assert whole == cut and len(cut) == 50 * 19


def test_pack_columns_of_arrays(spark):
    values = {1: [[5, 6], [7, 8]], 2: [[9, 10]]}
    d = spark.createDataFrame([(k, v) for k, v in values.items()], "seq long, values array<array<int>>")
    rows, _ = layouts.pack_columns(d, 1, 6)
    assert [(r.input, r.target, r.is_mask) for r in rows.orderBy("t").collect()] == [([0, 0], [1, 1], True), ([5, 6], [7, 8], False), ([0, 0], [1, 1], True)]
    frames = spark.createDataFrame([(1, [[[1.5], [2.5]]])], "seq long, values array<array<array<double>>>")
    rows, _ = layouts.pack_columns(frames, 1, 6, shifted=False)
    assert [(r.input, r.target) for r in rows.orderBy("t").collect()] == [([[0.0], [0.0]],) * 2, ([[1.5], [2.5]],) * 2]


@pytest.mark.parametrize("columns,width,targets", [(3, 4, True), (3, 4, False), (2, None, False), (5, 1, True), (60, 7, True)])
def test_runs_of_texts(spark, columns, width, targets):
    """The parts of texts make up each batch once, with the words and places that folding word by word gives."""
    words = [f"w{i}" for i in range(50)]
    cuts = [0, 0, 1, 2, 14, 15, 40, 40, 50]  # texts without a word, of one word, and over several batches and columns
    texts = [(i, words[a:b], a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    d = spark.createDataFrame(texts, "k long, words array<string>, _before long").repartition(3)
    got = layouts.runs(d, columns, len(words), lambda at, n: F.slice("words", at, n), width, targets).collect()
    s = len(words) // columns
    want = {(p // s, p % s): words[p] for p in range(s * columns) if p % s < s - targets} if s else {}
    assert sum(r.steps for r in got) == len(want)
    assert {(r.lane, r.t + i): w for r in got for i, w in enumerate(r.value)} == want
    assert all(r.batch == (r.t // width if width else 0) and r.steps == len(r.value) for r in got)
    n = Counter((lane, t // width if width else 0) for lane, t in want)
    assert all(r.whole == (r.steps == n[r.lane, r.batch]) for r in got)
    some = [layouts.runs(d, columns, len(words), lambda at, n: F.slice("words", at, n), width, targets, whole=x).collect() for x in (True, False)]
    assert sorted(some[0] + some[1]) == sorted(got) and all(r.whole for r in some[0])


@pytest.mark.parametrize("name", ["fold_chunk", "fold_columns"])
def test_folds_move_parts_of_texts(spark, name):
    """One row a part of a text goes on, not one a word."""
    from batchlake.plans import catalog
    from conftest import SF

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
    assert "generate explode" in plan and "posexplode" not in plan
