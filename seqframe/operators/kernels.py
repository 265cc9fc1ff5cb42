"""Entry points of the low-level sorting and scanning kernels.  ``param`` sets the rows of a bucket, the work of a task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import sorting
from .aggregate import SCANS, inclusive_scan


@dataclass(frozen=True)
class KernelParam:
    """Elements that one item handles, and items in a group: together the rows of a bucket."""

    data_per_workitem: int = 256
    workgroup_size: int = 256

    @property
    def bucket(self) -> int:
        return self.data_per_workitem * self.workgroup_size


def radix_sort(s: DataFrame, ascending: bool = True, param: KernelParam = KernelParam()) -> DataFrame:
    """Sort numbers; Spark's own sorter uses radix passes on the key prefix."""
    if s.schema["v"].dataType.typeName() in ("string", "binary", "array", "struct"):
        raise TypeError("radix_sort takes numbers")
    return sorting.sort(s, descending=not ascending, rows=param.bucket)


def radix_sort_by_key(s: DataFrame, ascending: bool = True, param: KernelParam = KernelParam()) -> DataFrame:
    return sorting.sort_by_key(s, descending=not ascending, rows=param.bucket)


def single_pass_inclusive_scan(s: DataFrame, op: str = "plus", param: KernelParam = KernelParam()) -> DataFrame:
    """Inclusive scan for operations with a known identity."""
    if op not in SCANS:
        raise ValueError(f"{op} has no known identity here")
    return inclusive_scan(s, op, bucket=param.bucket)
