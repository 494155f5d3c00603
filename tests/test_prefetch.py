import pytest

from batchlake.functions import dump
from batchlake.operators import batches
from batchlake.operators.prefetch import Prefetch


def test_same_batches_as_without(spark):
    plan = batches.sequential(spark, 100, 16, 100, 29)
    want = [sorted(r._idx for r in plan.filter(f"batch = {b}").collect()) for b in range(7)]
    p = Prefetch(2, 3)
    got = [sorted(r._idx for r in rows) for rows in p.batches(lambda b: plan.filter(f"batch = {b}"), range(7))]
    assert got == want and sorted(x for b in got for x in b) == list(range(1, 101))
    it = p.batches(lambda b: plan.filter(f"batch = {b}"), range(7))
    next(it)
    with pytest.raises(RuntimeError, match="active"):
        next(p.batches(lambda b: plan, range(1), "random"))
    p.synchronize()
    p.close()


def test_jobs_errors_and_bounds():
    seen = []
    p = Prefetch(1, 2, seen.append)
    p.put(lambda a, b: a + b, 1, 2)
    p.put(lambda: 1 / 0)
    with pytest.raises(RuntimeError, match="too many"):
        p.put(print)
    assert p.get() == 3 and seen == [0]
    with pytest.raises(ZeroDivisionError):
        p.get()
    with pytest.raises(RuntimeError, match="nothing"):
        p.get()
    p.close()


def test_dump():
    assert dump.table({"b": 1, "a": 'x"y', 3: [1, None]}, sort=True) == '{[3] = [1, None], a = "x\\"y", b = 1}'
    assert dump.table({"a": {"b": "c"}, "d": 2}, newline=True) == '{a = {b = "c"},\n d = 2}'
