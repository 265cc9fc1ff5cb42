"""Function objects over Columns, complex numbers and ratios over structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ranking import div
from .math import gcd


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def multiplies(a: Column, b: Column) -> Column:
    return a * b


def divides(a: Column, b: Column) -> Column:
    return a / b


def modulus(a: Column, b: Column) -> Column:
    return a % b


def negate(a: Column) -> Column:
    return -a


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def equal_to(a: Column, b: Column) -> Column:
    return a == b


def not_equal_to(a: Column, b: Column) -> Column:
    return a != b


def less(a: Column, b: Column) -> Column:
    return a < b


def less_equal(a: Column, b: Column) -> Column:
    return a <= b


def greater(a: Column, b: Column) -> Column:
    return a > b


def greater_equal(a: Column, b: Column) -> Column:
    return a >= b


def logical_and(a: Column, b: Column) -> Column:
    return a & b


def logical_or(a: Column, b: Column) -> Column:
    return a | b


def logical_not(a: Column) -> Column:
    return ~a


def identity(a: Column) -> Column:
    return a


maximum, minimum = F.greatest, F.least


def not_fn(f):
    """The negation of a predicate of any number of Columns."""
    return lambda *a: ~f(*a)


def bind(f, *fixed):
    """``f`` with its first arguments given."""
    return lambda *rest: f(*fixed, *rest)


# serial forms over array columns


def accumulate(a: Column, init: Column, op=plus) -> Column:
    return F.aggregate(a, init, op)


def inner_product(a: Column, b: Column, init: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, multiplies), init, plus)


def partial_sum(a: Column) -> Column:
    kind = lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)
    return F.aggregate(a, F.filter(a, lambda _: F.lit(False)), kind)


def iota(n: Column, start: Column) -> Column:
    return F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(F.slice(F.array(start), 1, 0))


# complex numbers: struct(re, im)


def complex_(re, im=0.0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_col(re).cast("double").alias("re"), as_col(im).cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def norm(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def cabs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def proj(z: Column) -> Column:
    inf = F.lit(float("inf"))
    far = (F.abs(z["re"]) == inf) | (F.abs(z["im"]) == inf)
    return F.when(far, complex_(inf, F.when(z["im"] < 0, F.lit(-0.0)).otherwise(0.0))).otherwise(z)


def polar(r: Column, theta: Column) -> Column:
    return complex_(r * F.cos(theta), r * F.sin(theta))


def cadd(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def csub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def cmul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cdiv(a: Column, b: Column) -> Column:
    n = norm(b)
    m = cmul(a, conj(b))
    return complex_(m["re"] / n, m["im"] / n)


def cexp(z: Column) -> Column:
    return polar(F.exp(z["re"]), z["im"])


def clog(z: Column) -> Column:
    return complex_(F.log(cabs(z)), arg(z))


def clog10(z: Column) -> Column:
    return complex_(F.log10(cabs(z)), arg(z) / F.log(F.lit(10.0)))


def csqrt(z: Column) -> Column:
    return polar(F.sqrt(cabs(z)), arg(z) / 2)


def cpow(a: Column, b: Column) -> Column:
    return F.when(norm(a) == 0, complex_(0.0)).otherwise(cexp(cmul(b, clog(a))))


def csin(z: Column) -> Column:
    return complex_(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))


def ccos(z: Column) -> Column:
    return complex_(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))


def ctan(z: Column) -> Column:
    return cdiv(csin(z), ccos(z))


def csinh(z: Column) -> Column:
    return complex_(F.sinh(z["re"]) * F.cos(z["im"]), F.cosh(z["re"]) * F.sin(z["im"]))


def ccosh(z: Column) -> Column:
    return complex_(F.cosh(z["re"]) * F.cos(z["im"]), F.sinh(z["re"]) * F.sin(z["im"]))


def ctanh(z: Column) -> Column:
    return cdiv(csinh(z), ccosh(z))


def _focal(x: Column, y: Column) -> tuple[Column, Column]:
    """Half the sum of the distances to 1 and -1, and the real part over it: cosh and sine of the inverse sine's parts."""
    half = F.greatest((F.hypot(x + 1.0, y) + F.hypot(x - 1.0, y)) / 2.0, F.lit(1.0))
    return half, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / half))


def _signed(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -size).otherwise(size)


def casin(z: Column) -> Column:
    a, b = _focal(z["re"], z["im"])
    return complex_(F.asin(b), _signed(F.acosh(a), z["im"]))


def cacos(z: Column) -> Column:
    a, b = _focal(z["re"], z["im"])
    return complex_(F.acos(b), -_signed(F.acosh(a), z["im"]))


def catan(z: Column) -> Column:
    x, y = z["re"], z["im"]
    return complex_(F.atan2(x * 2.0, 1.0 - x * x - y * y) / 2.0, F.log((x * x + (y + 1.0) * (y + 1.0)) / (x * x + (y - 1.0) * (y - 1.0))) / 4.0)


def casinh(z: Column) -> Column:
    a, b = _focal(-z["im"], z["re"])
    return complex_(_signed(F.acosh(a), z["re"]), -F.asin(b))


def cacosh(z: Column) -> Column:
    a, b = _focal(z["re"], z["im"])
    return complex_(F.acosh(a), _signed(F.acos(b), z["im"]))


def catanh(z: Column) -> Column:
    x, y = z["re"], z["im"]
    return complex_(F.log(((x + 1.0) * (x + 1.0) + y * y) / ((1.0 - x) * (1.0 - x) + y * y)) / 4.0, F.atan2(y * 2.0, 1.0 - x * x - y * y) / 2.0)


# ratios: struct(num, den) in lowest terms, den > 0


def ratio(num, den=1) -> Column:
    n, d = (x if isinstance(x, Column) else F.lit(int(x)) for x in (num, den))
    g = F.greatest(gcd(n, d), F.lit(1)) * F.when(d < 0, -1).otherwise(1)
    return F.struct(div(n.cast("long"), g).alias("num"), div(d.cast("long"), g).alias("den"))


def ratio_add(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def ratio_subtract(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def ratio_multiply(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["num"], a["den"] * b["den"])


def ratio_divide(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"], a["den"] * b["num"])


def ratio_equal(a: Column, b: Column) -> Column:
    return (a["num"] == b["num"]) & (a["den"] == b["den"])


def ratio_less(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] < b["num"] * a["den"]


def ratio_less_equal(a: Column, b: Column) -> Column:
    return ~ratio_less(b, a)


def ratio_greater(a: Column, b: Column) -> Column:
    return ratio_less(b, a)


def ratio_greater_equal(a: Column, b: Column) -> Column:
    return ~ratio_less(a, b)


def ratio_not_equal(a: Column, b: Column) -> Column:
    return ~ratio_equal(a, b)
