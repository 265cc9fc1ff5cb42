"""Published outputs, independence of partitioning, moments of distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.functions import random as rnd

#: The 10,000th output of each engine at its default seed (fixed values of the C++ standard).
TEN_THOUSANDTH = {
    "minstd_rand0": 1043618065,
    "minstd_rand": 399268537,
    "ranlux24_base": 7937952,
    "ranlux48_base": 61839128582725,
    "ranlux24": 9901578,
    "ranlux48": 249142670248501,
    "philox4x32": 1955073260,
    "philox4x64": 3409172418970261260,
}


@pytest.mark.parametrize("name", sorted(TEN_THOUSANDTH))
def test_ten_thousandth(spark, name):
    engine = getattr(rnd, name)()
    assert int(engine.at(np.array([9999]))[0]) == TEN_THOUSANDTH[name]
    rows = rnd.numbers(spark, 50, engine, start=9975).orderBy("pos").collect()
    assert [int(r.v) for r in rows] == [int(x) for x in engine.at(np.arange(9975, 10025))]
    assert int(rows[24].v) == TEN_THOUSANDTH[name]


MOMENTS = {
    "distribution_uniform_real": (1.0, 4 / math.sqrt(12)),
    "distribution_uniform_int": (3.5, math.sqrt(35 / 12)),
    "distribution_exponential": (1.0, 1.0),
    "distribution_geometric": (4.0, math.sqrt(0.8) / 0.2),
    "distribution_extreme_value": (0.5772, math.pi / math.sqrt(6)),
    "distribution_weibull": (1.5 * math.gamma(1.5), 1.5 * math.sqrt(1 - math.gamma(1.5) ** 2)),
    "distribution_normal": (0.0, 1.0),
}


@pytest.mark.parametrize("name", sorted(MOMENTS))
def test_moments(spark, sf, name):
    from seqframe import registry

    mean, dev = MOMENTS[name]
    row = registry.QUERIES[name](spark, sf).agg(F.avg("v").alias("m"), F.stddev("v").alias("d")).head()
    assert abs(row.m - mean) < 0.05 * max(1, dev) and abs(row.d - dev) < 0.06 * dev
