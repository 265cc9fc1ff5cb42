"""Scalar functions against Python's own, complex numbers and ratios against cmath and fractions."""

import cmath
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seqframe.functions import functors as fn
from seqframe.functions import math as fm

X = [-3.5, -1.0, -0.25, 0.0, 0.5, 1.0, 2.5, 7.0]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(x, 2.0, int(abs(x) * 4), 6) for x in X], "x double, y double, n long, m long")


def near(got, want):
    return (math.isnan(got) and math.isnan(want)) or got == want or abs(got - want) <= 1e-9 * max(1, abs(want))


UNARY = {
    "exp2": lambda x: 2**x, "trunc": math.trunc, "round": lambda x: math.copysign(math.floor(abs(x) + 0.5), x), "erf": math.erf, "erfc": math.erfc, "cbrt": math.cbrt, "expm1": math.expm1, "rint": round,
    "lgamma": lambda x: math.inf if x <= 0 and x == int(x) else math.lgamma(x), "isinf": math.isinf, "isfinite": math.isfinite,
}


@pytest.mark.parametrize("name", sorted(UNARY))
def test_unary(frame, name):
    got = [r[0] for r in frame.select(getattr(fm, name)(F.col("x"))).collect()]
    assert all(near(float(g), float(UNARY[name](x))) for g, x in zip(got, X))


BINARY = {
    "fdim": lambda a, b: max(a - b, 0), "fmax": max, "fmin": min, "fmod": math.fmod, "remainder": math.remainder, "copysign": math.copysign, "nextafter": math.nextafter, "isless": lambda a, b: a < b, "isgreaterequal": lambda a, b: a >= b, "hypot": math.hypot, "atan2": math.atan2,
}


@pytest.mark.parametrize("name", sorted(BINARY))
def test_binary(frame, name):
    got = [r[0] for r in frame.select(getattr(fm, name)(F.col("x"), F.col("y"))).collect()]
    assert all(near(float(g), float(BINARY[name](x, 2.0))) for g, x in zip(got, X))


def test_parts(frame):
    rows = frame.select(fm.frexp("x").alias("f"), fm.modf(F.col("x")).alias("m"), fm.gcd(F.col("n"), F.col("m")).alias("g"), fm.lcm(F.col("n"), F.col("m")).alias("l"), fm.ldexp("x", F.lit(3)).alias("s")).collect()
    for r, x in zip(rows, X):
        assert (r.f.fraction, r.f.exponent) == math.frexp(x) and (r.m.fraction, r.m.whole) == math.modf(x) and r.s == x * 8
        assert r.g == math.gcd(int(abs(x) * 4), 6) and r.l == math.lcm(int(abs(x) * 4), 6)


COMPLEX = {"cexp": cmath.exp, "clog": cmath.log, "csqrt": cmath.sqrt, "csin": cmath.sin, "ccos": cmath.cos, "ctan": cmath.tan, "csinh": cmath.sinh, "ccosh": cmath.cosh, "ctanh": cmath.tanh, "casin": cmath.asin, "cacos": cmath.acos, "catan": cmath.atan, "casinh": cmath.asinh, "cacosh": cmath.acosh, "catanh": cmath.atanh, "conj": lambda z: z.conjugate()}


@pytest.mark.parametrize("name", sorted(COMPLEX))
def test_complex(frame, name):
    rows = frame.select(getattr(fn, name)(fn.complex_(F.col("x"), F.lit(0.75))).alias("z")).collect()
    for r, x in zip(rows, X):
        assert abs(complex(r.z.re, r.z.im) - COMPLEX[name](complex(x, 0.75))) < 1e-9


def test_complex_arithmetic(frame):
    a, b = fn.complex_(F.col("x"), F.lit(1.0)), fn.complex_(F.lit(2.0), F.lit(-3.0))
    rows = frame.select(fn.cmul(a, b).alias("m"), fn.cdiv(a, b).alias("d"), fn.cpow(a, b).alias("p"), fn.cabs(a).alias("r"), fn.arg(a).alias("t")).collect()
    for r, x in zip(rows, X):
        z, w = complex(x, 1), complex(2, -3)
        for got, want in ((r.m, z * w), (r.d, z / w), (r.p, z**w)):
            assert abs(complex(got.re, got.im) - want) < 1e-8 * max(1, abs(want))
        assert near(r.r, abs(z)) and near(r.t, cmath.phase(z))


def test_ratios(frame):
    a, b = fn.ratio(F.col("n") + 1, F.lit(-6)), fn.ratio(F.lit(3), F.lit(4))
    ops = {"ratio_add": Fraction.__add__, "ratio_subtract": Fraction.__sub__, "ratio_multiply": Fraction.__mul__, "ratio_divide": Fraction.__truediv__}
    rows = frame.select(*[getattr(fn, n)(a, b).alias(n) for n in ops], fn.ratio_less(a, b).alias("less")).collect()
    for r, x in zip(rows, X):
        p, q = Fraction(int(abs(x) * 4) + 1, -6), Fraction(3, 4)
        assert all(Fraction(r[n].num, r[n].den) == f(p, q) and r[n].den > 0 for n, f in ops.items()) and r.less == (p < q)


def test_serial_forms(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5, 6]), ([], [])], "a array<long>, b array<long>")
    rows = df.select(fn.accumulate(F.col("a"), F.lit(10).cast("long")).alias("s"), fn.inner_product(F.col("a"), F.col("b"), F.lit(0).cast("long")).alias("d"), fn.partial_sum(F.col("a")).alias("p"), fn.iota(F.size("a"), F.lit(5)).alias("i")).collect()
    assert [tuple(r) for r in rows] == [(16, 32, [1, 3, 6], [5, 6, 7]), (10, 0, [], [])]


def test_edges(spark):
    odd = [0.49999999999999994, -0.5, 2.5, 1e19, -1e19, math.inf, -math.inf, math.nan, -0.0, 4503599627370497.5]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select("x", fm.trunc(F.col("x")).alias("t"), fm.round(F.col("x")).alias("r"), fm.copysign(F.lit(1.0), F.col("x")).alias("s")).collect()
    for r in rows:
        if math.isfinite(r.x):
            half = math.copysign(math.floor(abs(Fraction(r.x)) + Fraction(1, 2)), r.x)
            assert r.t == math.trunc(r.x) and r.r == half
        else:
            assert str(r.t) == str(r.x) == str(r.r)
        assert math.isnan(r.x) or r.s == math.copysign(1.0, r.x)
    big = spark.createDataFrame([(2**53 + 1, 1, None)], "a long, b long, c long")
    r = big.select(fm.lcm(F.col("a"), F.col("b")).alias("l"), fn.ratio(F.col("a"), F.col("b")).alias("q"), fm.gcd(F.col("a"), F.col("c")).alias("n")).head()
    assert r.l == r.q.num == 2**53 + 1 and r.n is None
    assert spark.range(1).select(fm.fma(F.lit(0.1), F.lit(10.0), F.lit(-1.0))).head()[0] == 5.551115123125783e-17
