"""Operators that return at once.  A future's ``get`` gives the frame or value; jobs run in threads."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame
from pyspark.util import inheritable_thread_target

from ..operators import aggregate, rearrange, search, sorting

_pool = ThreadPoolExecutor(max_workers=16, thread_name_prefix="seqframe-async")


class Async:
    """A submitted operation; may be passed as a dependency to another."""

    def __init__(self, future: Future):
        self._future = future

    def get(self):
        return self._future.result()

    def wait(self) -> None:
        wait([self._future])

    def done(self) -> bool:
        return self._future.done()


def submit(spark, work: Callable, *after: Async) -> Async:
    def run():
        for x in after:
            x.get()
        return work()

    return Async(_pool.submit(inheritable_thread_target(spark)(run)))


def _frame(make: Callable[[], DataFrame], source: DataFrame, after: tuple[Async, ...]) -> Async:
    """Compute the frame in the background; what ``get`` returns is held in memory or on disk."""

    def work() -> DataFrame:
        out = make().persist()
        out.count()
        return out

    return submit(source.sparkSession, work, *after)


def copy_async(s: DataFrame, *after: Async) -> Async:
    return _frame(lambda: rearrange.copy(s), s, after)


def fill_async(s: DataFrame, value, *after: Async) -> Async:
    return _frame(lambda: rearrange.fill(s, value), s, after)


def for_each_async(s: DataFrame, f: Callable, *after: Async) -> Async:
    return _frame(lambda: search.for_each(s, f), s, after)


def transform_async(s: DataFrame, op: Callable, *after: Async, other: DataFrame | None = None) -> Async:
    return _frame(lambda: rearrange.transform(s, op) if other is None else rearrange.transform_binary(s, other, op), s, after)


def sort_async(s: DataFrame, *after: Async, descending: bool = False) -> Async:
    return _frame(lambda: sorting.sort(s, descending), s, after)


def reduce_async(s: DataFrame, init=0, op="plus", *after: Async) -> Async:
    return submit(s.sparkSession, lambda: aggregate.reduce(s, init, op).head().result, *after)


def transform_reduce_async(s: DataFrame, init, op, unary: Callable, *after: Async) -> Async:
    return submit(s.sparkSession, lambda: aggregate.transform_reduce(s, init, op, unary).head().result, *after)


def inclusive_scan_async(s: DataFrame, op="plus", init=None, *after: Async) -> Async:
    return _frame(lambda: aggregate.inclusive_scan(s, op, init), s, after)


def exclusive_scan_async(s: DataFrame, init=0, op="plus", *after: Async) -> Async:
    return _frame(lambda: aggregate.exclusive_scan(s, init, op), s, after)


def transform_inclusive_scan_async(s: DataFrame, op, unary: Callable, init=None, *after: Async) -> Async:
    return _frame(lambda: aggregate.transform_inclusive_scan(s, op, unary, init), s, after)


def transform_exclusive_scan_async(s: DataFrame, init, op, unary: Callable, *after: Async) -> Async:
    return _frame(lambda: aggregate.transform_exclusive_scan(s, init, op, unary), s, after)


def wait_for_all(*events: Async) -> None:
    wait([e._future for e in events])
    for e in events:
        e.get()
