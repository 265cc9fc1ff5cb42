"""Execution policies: how the tasks of an operator are laid out.

A policy calls an operator: ``par(sort, s)`` is ``sort(s)``, which Spark plans in parallel and vectorised.
``seq`` and ``unseq`` give the operator's sequences and its result one task each, for debugging.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ExecutionPolicy:
    name: str
    parallel: bool = True

    def laid(self, x):
        return x.coalesce(1) if isinstance(x, DataFrame) and not self.parallel else x

    def __call__(self, operator: Callable, *args, **more):
        return self.laid(operator(*map(self.laid, args), **{k: self.laid(x) for k, x in more.items()}))


seq = ExecutionPolicy("seq", parallel=False)
unseq = ExecutionPolicy("unseq", parallel=False)
par = ExecutionPolicy("par")
par_unseq = ExecutionPolicy("par_unseq")
device_policy = ExecutionPolicy("device")


def is_execution_policy(x: object) -> bool:
    return isinstance(x, ExecutionPolicy)
