"""Mathematical functions of Columns.  What Spark has no built-in for runs in Arrow batches."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..plans.ranking import div

acos, acosh, asin, asinh, atan, atan2, atanh = F.acos, F.acosh, F.asin, F.asinh, F.atan, F.atan2, F.atanh
cbrt, ceil, cos, cosh, exp, expm1, fabs, floor = F.cbrt, F.ceil, F.cos, F.cosh, F.exp, F.expm1, F.abs, F.floor
hypot, log, log10, log1p, log2, pow, sin, sinh, sqrt, tan, tanh = F.hypot, F.log, F.log10, F.log1p, F.log2, F.pow, F.sin, F.sinh, F.sqrt, F.tan, F.tanh
isnan, nearbyint, rint = F.isnan, F.rint, F.rint


def _d(c: Column) -> Column:
    return c.cast("double")


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def fdim(a: Column, b: Column) -> Column:
    return F.when(a > b, a - b).otherwise(F.lit(0.0))


def fmax(a: Column, b: Column) -> Column:
    """The larger; NaN counts as missing."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; NaN for b = 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(_d(a) % _d(b))


#: From here on every double is a whole number.
_WHOLE = float(1 << 52)


def trunc(x: Column) -> Column:
    """The whole part; infinities, NaN and large numbers stay as they are."""
    return F.when(F.abs(_d(x)) < _WHOLE, F.signum(_d(x)) * F.floor(F.abs(_d(x)))).otherwise(_d(x))


def round(x: Column) -> Column:
    """Half away from zero."""
    whole = trunc(x)
    return F.when(F.abs(_d(x) - whole) >= 0.5, whole + F.signum(_d(x))).otherwise(whole)


def modf(x: Column) -> Column:
    whole = trunc(_d(x))
    return F.struct((x - whole).alias("fraction"), whole.alias("whole"))


def remainder(a: Column, b: Column) -> Column:
    """a - n b with n = a / b rounded half to even."""
    return _d(a) - F.rint(_d(a) / _d(b)) * _d(b)


def remquo(a: Column, b: Column) -> Column:
    n = F.rint(_d(a) / _d(b))
    return F.struct((_d(a) - n * _d(b)).alias("remainder"), n.cast("long").alias("quotient"))


def copysign(a: Column, b: Column) -> Column:
    minus = (b < 0) | ((b == 0) & F.startswith(_d(b).cast("string"), F.lit("-")))
    return F.abs(_d(a)) * F.when(minus, -1.0).otherwise(1.0)


def signbit(x: Column) -> Column:
    return copysign(F.lit(1.0), x) < 0


def isinf(x: Column) -> Column:
    return F.abs(_d(x)) == F.lit(float("inf"))


def isfinite(x: Column) -> Column:
    return ~F.isnan(_d(x)) & ~isinf(x)


def isunordered(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def isgreater(a: Column, b: Column) -> Column:
    return ~isunordered(a, b) & (a > b)


def isgreaterequal(a: Column, b: Column) -> Column:
    return ~isunordered(a, b) & (a >= b)


def isless(a: Column, b: Column) -> Column:
    return ~isunordered(a, b) & (a < b)


def islessequal(a: Column, b: Column) -> Column:
    return ~isunordered(a, b) & (a <= b)


def islessgreater(a: Column, b: Column) -> Column:
    return ~isunordered(a, b) & (a != b)


def _vector(name: str, f) -> object:
    @pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if v is None or np.isnan(v) else f(v) for v in x.to_numpy(float)])

    run.__name__ = name
    return run


def _gamma(x: float) -> float:
    try:
        return math.gamma(x)
    except (ValueError, OverflowError):
        return float("inf") if x >= 0 else float("nan")


def _lgamma(x: float) -> float:
    try:
        return math.lgamma(x)
    except ValueError:
        return float("inf")


erf = _vector("erf", math.erf)
erfc = _vector("erfc", math.erfc)
tgamma = _vector("tgamma", _gamma)
lgamma = _vector("lgamma", _lgamma)


@pandas_udf(T.DoubleType())
def nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(a.to_numpy(float), b.to_numpy(float)))


@pandas_udf(T.LongType())
def ilogb(x: pd.Series) -> pd.Series:
    return pd.Series(np.frexp(x.to_numpy(float))[1].astype(np.int64) - 1)


@pandas_udf(T.DoubleType())
def logb(x: pd.Series) -> pd.Series:
    return pd.Series(np.frexp(x.to_numpy(float))[1] - 1.0)


@pandas_udf(T.DoubleType())
def ldexp(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(np.ldexp(x.to_numpy(float), n.to_numpy(int)))


@pandas_udf(T.StructType([T.StructField("fraction", T.DoubleType()), T.StructField("exponent", T.LongType())]))
def frexp(x: pd.Series) -> pd.DataFrame:
    m, e = np.frexp(x.to_numpy(float))
    return pd.DataFrame({"fraction": m, "exponent": e.astype(np.int64)})


scalbn = ldexp


@pandas_udf(T.DoubleType())
def fma(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """a b + c, rounded once."""
    return pd.Series(list(map(_fma, a.to_numpy(float), b.to_numpy(float), c.to_numpy(float))))


def _fma(a: float, b: float, c: float) -> float:
    try:
        return float(Fraction(a) * Fraction(b) + Fraction(c))
    except (ValueError, OverflowError):  # infinities, NaN, and results beyond the largest double
        return a * b + c


@pandas_udf(T.LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers; null if either is."""
    whole = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return F.when(a.isNotNull() & b.isNotNull(), _gcd(whole(a), whole(b)))


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(div(F.abs(a.cast("long")), g) * F.abs(b.cast("long")))
