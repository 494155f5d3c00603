"""Epochs computed ahead: jobs in flight while earlier batches are used."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame


class Prefetch:
    """Runs functions (usually Spark actions) in `threads` threads, at most `ahead` of them waiting to be fetched.

    put() gives one in, get() takes the oldest result; an error of a job is raised
    by the get() that would give its result. One iterator is active at a time:
    synchronize() drops what is under way, and is needed before the next one if
    the last was not used up. `start` in a worker is called once with its number.
    """

    def __init__(self, threads: int = 2, ahead: int = 16, start: Callable[[int], None] | None = None) -> None:
        self._count = iter(range(threads))
        self._pool = ThreadPoolExecutor(threads, initializer=(lambda: start(next(self._count))) if start else None)
        self._flight: deque[Future] = deque()
        self._ahead = ahead
        self._mode: str | None = None

    def put(self, job: Callable[..., Any], *args: Any) -> None:
        if len(self._flight) >= self._ahead:
            raise RuntimeError("too many results are waiting to be fetched")
        self._flight.append(self._pool.submit(job, *args))

    def get(self) -> Any:
        if not self._flight:
            raise RuntimeError("nothing was put")
        return self._flight.popleft().result()

    def synchronize(self) -> None:
        while self._flight:
            f = self._flight.popleft()
            if not f.cancel():
                f.exception()
        self._mode = None

    def batches(self, plan: Callable[[int], DataFrame], numbers: range, mode: str = "sequential") -> Iterator[list]:
        """Rows of plan(n) for each n, in order, with up to `ahead` of them computed in advance."""
        if self._mode is not None:
            raise RuntimeError(f"the {self._mode} iterator is active; synchronize() ends it")
        self._mode = mode
        todo = iter(numbers)
        for n in islice(todo, self._ahead):
            self.put(lambda n=n: plan(n).collect())
        while self._flight:
            rows = self.get()
            for n in todo:
                self.put(lambda n=n: plan(n).collect())
                break
            yield rows
        self._mode = None

    def close(self) -> None:
        self.synchronize()
        self._pool.shutdown()
