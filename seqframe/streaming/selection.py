"""Choice of the resource that runs a piece of work.

A resource is anything: a scheduler pool, a session, a setting.  Work is a function of the resource.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait as wait_futures


class Selection:
    """A chosen resource, with what its policy wants to hear about the work."""

    def __init__(self, policy: Policy, index: int, note: object = None):
        self.policy, self.index, self.note = policy, index, note

    def unwrap(self):
        return self.policy.resources[self.index]


class Submission:
    def __init__(self, future: Future):
        self._future = future

    def wait(self):
        return self._future.result()

    def unwrap(self) -> Future:
        return self._future


class Policy:
    """Holds the resources and the work in flight; subclasses choose."""

    def __init__(self, resources: Sequence):
        if not resources:
            raise ValueError("a policy needs resources")
        self.resources = list(resources)
        self._lock = threading.Lock()
        self._flight: list[Future] = []
        self._pool = ThreadPoolExecutor(max_workers=max(4, 2 * len(self.resources)))

    def choose(self, work: Callable | None) -> tuple[int, object]:
        raise NotImplementedError

    def report(self, selection: Selection, what: str, seconds: float | None = None) -> None:
        """``what``: task_submission, task_completion or task_time."""


class FixedResource(Policy):
    def __init__(self, resources: Sequence, offset: int = 0):
        super().__init__(resources)
        self._offset = offset

    def choose(self, work):
        return self._offset, None


class RoundRobin(Policy):
    def __init__(self, resources: Sequence):
        super().__init__(resources)
        self._next = 0

    def choose(self, work):
        with self._lock:
            i, self._next = self._next, (self._next + 1) % len(self.resources)
        return i, None


class DynamicLoad(Policy):
    """The resource with the least work in flight."""

    def __init__(self, resources: Sequence):
        super().__init__(resources)
        self._load = [0] * len(self.resources)

    def choose(self, work):
        with self._lock:
            return min(range(len(self._load)), key=self._load.__getitem__), None

    def report(self, selection, what, seconds=None):
        with self._lock:
            self._load[selection.index] += {"task_submission": 1, "task_completion": -1}.get(what, 0)


class AutoTune(Policy):
    """Each task is timed once on every resource and then runs on the fastest; ``resample`` seconds renew this."""

    def __init__(self, resources: Sequence, resample: float | None = None, key: Callable[[Callable], Hashable] | None = None):
        super().__init__(resources)
        self._resample, self._key = resample, key or (lambda work: getattr(work, "__code__", work))
        self._state: dict[Hashable, dict] = {}

    def choose(self, work):
        with self._lock:
            name, now = self._key(work), time.monotonic()
            s = self._state.get(name)
            if s is None or (self._resample is not None and now - s["since"] >= self._resample and len(s["best"]) == len(self.resources)):
                s = self._state[name] = {"tried": 0, "best": {}, "since": now}
            if s["tried"] < len(self.resources):
                i, s["tried"] = s["tried"], s["tried"] + 1
            else:
                i = min(s["best"], key=s["best"].get, default=0)
            return i, name

    def report(self, selection, what, seconds=None):
        if what == "task_time" and seconds is not None:
            with self._lock:
                best = self._state[selection.note]["best"]
                best[selection.index] = min(seconds, best.get(selection.index, seconds))


def select(policy: Policy, work: Callable | None = None) -> Selection:
    index, note = policy.choose(work)
    return Selection(policy, index, note)


def submit(target: Policy | Selection, work: Callable) -> Submission:
    """Run ``work(resource)`` in the background on the selected resource."""
    chosen = target if isinstance(target, Selection) else select(target, work)
    policy = chosen.policy

    def run():
        begun = time.perf_counter()
        try:
            return work(chosen.unwrap())
        finally:
            policy.report(chosen, "task_time", time.perf_counter() - begun)
            policy.report(chosen, "task_completion")

    policy.report(chosen, "task_submission")
    future = policy._pool.submit(run)
    with policy._lock:
        policy._flight = [f for f in policy._flight if not f.done()] + [future]
    return Submission(future)


def submit_and_wait(target: Policy | Selection, work: Callable):
    return submit(target, work).wait()


def get_resources(policy: Policy) -> list:
    return list(policy.resources)


def get_submission_group(policy: Policy) -> Submission:
    """All work in flight as one thing to wait for."""
    group: Future = Future()
    with policy._lock:
        flight = list(policy._flight)

    def gather():
        wait_futures(flight)
        group.set_result([f.result() for f in flight if f.exception() is None])

    threading.Thread(target=gather, daemon=True).start()
    return Submission(group)


def wait(x: Submission):
    return x.wait()


def unwrap(x: Selection | Submission):
    return x.unwrap()


def in_pool(spark, name: str, work: Callable):
    """Run ``work()`` with its jobs in the named scheduler pool."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", name)
    try:
        return work()
    finally:
        sc.setLocalProperty("spark.scheduler.pool", before)
