"""Queries of scalar functions, function objects, random numbers and dynamic selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import functors as fn
from .functions import math as fm
from .functions import random as rnd
from .operators import aggregate as ag
from .operators import kernels
from .registry import ORACLE, SORTED, add, on_lines, on_orders, prices
from .streaming import selection as sel

# ---------------------------------------------------------------- math: x in [-4, 4], y in [1, 7], n in [0, 8]


def _x() -> Column:
    return (F.col("v") % 2001 - 1000) / 250.0


def _y() -> Column:
    return F.col("v") % 7 + 1.0


X, Y = "((v % 2001 - 1000) / 250.0::DOUBLE)", "(v % 7 + 1.0::DOUBLE)"
SERIES = f"list_sum(list_transform(range(0, 40), lambda n: pow(-1.0, n) * pow({X} / 2, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)))) * 2 / sqrt(pi())"


Columns = Callable[[], dict[str, Column]]


def on_values(name: str, columns: Columns, sql: dict[str, str]) -> None:
    """Each function of every order's value, to six places.  Columns are made when the query runs."""
    on_orders(
        name,
        lambda s: s.select("pos", *[(F.round(c.cast("double"), 6) + 0.0).alias(n) for n, c in columns().items()]),
        "SELECT pos, " + ", ".join(f"round(({x})::DOUBLE, 6) + 0.0 AS {n}" for n, x in sql.items()) + " FROM o",
    )



def _math_functions() -> dict[str, Column]:
    x, y = _x(), _y()
    return {
        "fabs": fm.fabs(x), "acos": fm.acos(x / 5.0), "acosh": fm.acosh(y), "asin": fm.asin(x / 5.0), "asinh": fm.asinh(x), "atan": fm.atan(x), "atan2": fm.atan2(x, y), "atanh": fm.atanh(x / 5.0),
        "cbrt": fm.cbrt(x), "ceil": fm.ceil(x), "cos": fm.cos(x), "cosh": fm.cosh(x), "exp": fm.exp(x), "exp2": fm.exp2(x), "expm1": fm.expm1(x), "floor": fm.floor(x), "hypot": fm.hypot(x, y),
        "log": fm.log(y), "log10": fm.log10(y), "log1p": fm.log1p(y), "log2": fm.log2(y), "pow": fm.pow(y, x), "sin": fm.sin(x), "sinh": fm.sinh(x), "sqrt": fm.sqrt(y), "tan": fm.tan(x / 4.0),
        "tanh": fm.tanh(x),
    }


on_values("math_functions", _math_functions, {
    "fabs": f"abs({X})", "acos": f"acos({X} / 5)", "acosh": f"acosh({Y})", "asin": f"asin({X} / 5)", "asinh": f"asinh({X})", "atan": f"atan({X})", "atan2": f"atan2({X}, {Y})", "atanh": f"atanh({X} / 5)",
    "cbrt": f"cbrt({X})", "ceil": f"ceil({X})", "cos": f"cos({X})", "cosh": f"cosh({X})", "exp": f"exp({X})", "exp2": f"pow(2, {X})", "expm1": f"exp({X}) - 1", "floor": f"floor({X})",
    "hypot": f"sqrt({X} * {X} + {Y} * {Y})", "log": f"ln({Y})", "log10": f"log10({Y})", "log1p": f"ln(1 + {Y})", "log2": f"log2({Y})", "pow": f"pow({Y}, {X})", "sin": f"sin({X})", "sinh": f"sinh({X})",
    "sqrt": f"sqrt({Y})", "tan": f"tan({X} / 4)", "tanh": f"(exp(2 * {X}) - 1) / (exp(2 * {X}) + 1)",
})


def _math_rounding() -> dict[str, Column]:
    x, y = _x(), _y()
    return {
        "trunc": fm.trunc(x), "round": fm.round(x * 2.0), "rint": fm.rint(x * 2.5), "nearbyint": fm.nearbyint(x), "fraction": fm.modf(x)["fraction"], "whole": fm.modf(x)["whole"], "fmod": fm.fmod(x, y),
        "remainder": fm.remainder(x, y), "remquo": fm.remquo(x, y)["quotient"], "fdim": fm.fdim(x, y), "fma": fm.fma(x, y, x), "fmax": fm.fmax(x, y), "fmin": fm.fmin(x, y), "copysign": fm.copysign(y, x),
        "signbit": fm.signbit(x), "whole_of_large": fm.trunc(x * 2.0**60) / 2.0**60,
    }


on_values("math_rounding", _math_rounding, {
    "trunc": f"trunc({X})", "round": f"sign({X}) * floor(abs({X} * 2) + 0.5)", "rint": f"round_even({X} * 2.5, 0)", "nearbyint": f"round_even({X}, 0)", "fraction": f"{X} - trunc({X})",
    "whole": f"trunc({X})", "fmod": f"{X} - trunc({X} / {Y}) * {Y}", "remainder": f"{X} - round_even({X} / {Y}, 0) * {Y}", "remquo": f"round_even({X} / {Y}, 0)", "fdim": f"greatest({X} - {Y}, 0)",
    "fma": f"{X} * {Y} + {X}", "fmax": f"greatest({X}, {Y})", "fmin": f"least({X}, {Y})", "copysign": f"CASE WHEN {X} < 0 THEN -{Y} ELSE {Y} END", "signbit": f"({X} < 0)::INTEGER",
    "whole_of_large": X,
})


def _special_functions() -> dict[str, Column]:
    x, y, n = _x(), _y(), F.col("v") % 9
    return {
        "erf": fm.erf(x / 2.0), "erfc": fm.erfc(x / 2.0), "tgamma": fm.tgamma(n + 1.0), "lgamma": fm.lgamma(n + 1.0), "ilogb": fm.ilogb(F.col("v") + 0.0), "logb": fm.logb(y), "ldexp": fm.ldexp(x, n),
        "scalbn": fm.scalbn(x, -n), "mantissa": fm.frexp(y)["fraction"], "exponent": fm.frexp(y)["exponent"], "ulp": (fm.nextafter(y, F.lit(9.0)) - y) * 1e15,
    }


on_values("special_functions", _special_functions, {
    "erf": SERIES, "erfc": f"1 - {SERIES}", "tgamma": "gamma(v % 9 + 1.0)", "lgamma": "lgamma(v % 9 + 1.0)", "ilogb": "floor(log2(v))", "logb": f"floor(log2({Y}))", "ldexp": f"{X} * pow(2, v % 9)",
    "scalbn": f"{X} / pow(2, v % 9)", "mantissa": f"{Y} / pow(2, floor(log2({Y})) + 1)", "exponent": f"floor(log2({Y})) + 1", "ulp": f"(nextafter({Y}, 9.0::DOUBLE) - {Y}) * 1e15",
})

ODD = f"CASE v % 9 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE {X} END"
APART = f"NOT isnan({ODD}) AND"


def _classification() -> dict[str, Column]:
    x, y, n = _x(), _y(), F.col("v") % 9
    odd = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("inf"))).when(n == 2, F.lit(float("-inf"))).otherwise(x)
    return {
        "isnan": fm.isnan(odd), "isinf": fm.isinf(odd), "isfinite": fm.isfinite(odd), "isunordered": fm.isunordered(odd, y), "isgreater": fm.isgreater(odd, y), "isgreaterequal": fm.isgreaterequal(odd, y),
        "isless": fm.isless(odd, y), "islessequal": fm.islessequal(odd, y), "islessgreater": fm.islessgreater(odd, y),
    }


on_values("classification", _classification, {
    "isnan": f"isnan({ODD})::INTEGER", "isinf": f"isinf({ODD})::INTEGER", "isfinite": f"isfinite({ODD})::INTEGER", "isunordered": f"isnan({ODD})::INTEGER", "isgreater": f"({APART} {ODD} > {Y})::INTEGER",
    "isgreaterequal": f"({APART} {ODD} >= {Y})::INTEGER", "isless": f"({APART} {ODD} < {Y})::INTEGER", "islessequal": f"({APART} {ODD} <= {Y})::INTEGER",
    "islessgreater": f"({APART} {ODD} <> {Y})::INTEGER",
})

COMPARED = {"equal_to": "=", "not_equal_to": "<>", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">="}


def _functors() -> dict[str, Column]:
    a, b = F.col("v"), F.col("pos") + 1
    return {
        "plus": fn.plus(a, b), "minus": fn.minus(a, b), "multiplies": fn.multiplies(a % 1000, b), "divides": fn.divides(a, b), "modulus": fn.modulus(a, b), "negate": fn.negate(a), "bit_and": fn.bit_and(a, b),
        "bit_or": fn.bit_or(a, b), "bit_xor": fn.bit_xor(a, b), "bit_not": fn.bit_not(a), "logical_and": fn.logical_and(a % 2 == 0, b % 3 == 0), "logical_or": fn.logical_or(a % 2 == 0, b % 3 == 0),
        "logical_not": fn.logical_not(a % 2 == 0), "not_fn": fn.not_fn(fn.less)(a % 5, b % 5), "bind": fn.bind(fn.minus, F.lit(7))(a), **{k: getattr(fn, k)(a % 5, b % 5) for k in COMPARED},
    }


on_values("functors", _functors, {
    "plus": "v + pos + 1", "minus": "v - pos - 1", "multiplies": "v % 1000 * (pos + 1)", "divides": "v / (pos + 1)", "modulus": "v % (pos + 1)", "negate": "-v", "bit_and": "v & (pos + 1)",
    "bit_or": "v | (pos + 1)", "bit_xor": "xor(v, pos + 1)", "bit_not": "~v", "logical_and": "(v % 2 = 0 AND (pos + 1) % 3 = 0)::INTEGER", "logical_or": "(v % 2 = 0 OR (pos + 1) % 3 = 0)::INTEGER",
    "logical_not": "(v % 2 <> 0)::INTEGER", "not_fn": "(v % 5 >= (pos + 1) % 5)::INTEGER", "bind": "7 - v", **{k: f"(v % 5 {op} (pos + 1) % 5)::INTEGER" for k, op in COMPARED.items()},
})


def _library_functors() -> dict[str, Column]:
    a, b = F.col("v"), F.col("pos") + 1
    return {
        "identity": fn.identity(a), "maximum": fn.maximum(a % 100, b), "minimum": fn.minimum(a % 100, b),
    }


on_values("library_functors", _library_functors, {
    "identity": "v", "maximum": "greatest(v % 100, pos + 1)", "minimum": "least(v % 100, pos + 1)",
})


def _complex() -> dict[str, Column]:
    """Of x + 0.75 i and y - 0.5 i."""
    x, y = _x(), _y()
    z, w = fn.complex_(x, F.lit(0.75)), fn.complex_(y, F.lit(-0.5))
    found = {
        "exp": fn.cexp(z), "log": fn.clog(z), "log10": fn.clog10(z), "sqrt": fn.csqrt(z), "sin": fn.csin(z), "cos": fn.ccos(z), "tan": fn.ctan(z), "sinh": fn.csinh(z), "cosh": fn.ccosh(z), "tanh": fn.ctanh(z),
        "conj": fn.conj(z), "proj": fn.proj(z), "polar": fn.polar(y, x), "add": fn.cadd(z, w), "sub": fn.csub(z, w), "mul": fn.cmul(z, w), "div": fn.cdiv(z, w), "pow": fn.cpow(z, fn.complex_(2.0)),
        "asin": fn.casin(z), "acos": fn.cacos(z), "atan": fn.catan(z), "asinh": fn.casinh(z), "acosh": fn.cacosh(z), "atanh": fn.catanh(z),
    }
    both = {f"{k}_{p}": c[p] for k, c in found.items() for p in ("re", "im")}
    return both | {"abs": fn.cabs(z), "arg": fn.arg(z), "norm": fn.norm(z), "real": fn.real(z), "imag": fn.imag(z)}


R, T = f"sqrt({X} * {X} + 0.5625)", f"atan2(0.75, {X})"
# half the sum of the distances to 1 and -1, and the real part over it; the same sum on the other axis
A = f"((sqrt(({X} + 1) * ({X} + 1) + 0.5625) + sqrt(({X} - 1) * ({X} - 1) + 0.5625)) / 2)"
B, C = f"({X} / {A})", f"((sqrt({X} * {X} + 0.0625) + sqrt({X} * {X} + 3.0625)) / 2)"
COMPLEX = {
    "exp": (f"exp({X}) * cos(0.75)", f"exp({X}) * sin(0.75)"), "log": (f"ln({R})", T), "log10": (f"log10({R})", f"{T} / ln(10)"), "sqrt": (f"sqrt({R}) * cos({T} / 2)", f"sqrt({R}) * sin({T} / 2)"),
    "sin": (f"sin({X}) * cosh(0.75)", f"cos({X}) * sinh(0.75)"), "cos": (f"cos({X}) * cosh(0.75)", f"-sin({X}) * sinh(0.75)"),
    "tan": (f"sin(2 * {X}) / (cos(2 * {X}) + cosh(1.5))", f"sinh(1.5) / (cos(2 * {X}) + cosh(1.5))"), "sinh": (f"sinh({X}) * cos(0.75)", f"cosh({X}) * sin(0.75)"),
    "cosh": (f"cosh({X}) * cos(0.75)", f"sinh({X}) * sin(0.75)"), "tanh": (f"sinh(2 * {X}) / (cosh(2 * {X}) + cos(1.5))", f"sin(1.5) / (cosh(2 * {X}) + cos(1.5))"), "conj": (X, "-0.75"),
    "proj": (X, "0.75"), "polar": (f"{Y} * cos({X})", f"{Y} * sin({X})"), "add": (f"{X} + {Y}", "0.25"), "sub": (f"{X} - {Y}", "1.25"), "mul": (f"{X} * {Y} + 0.375", f"0.75 * {Y} - 0.5 * {X}"),
    "div": (f"({X} * {Y} - 0.375) / ({Y} * {Y} + 0.25)", f"(0.75 * {Y} + 0.5 * {X}) / ({Y} * {Y} + 0.25)"), "pow": (f"{X} * {X} - 0.5625", f"1.5 * {X}"), "asin": (f"asin({B})", f"acosh({A})"), "acos": (f"acos({B})", f"-acosh({A})"),
    "atan": (f"atan2(2 * {X}, 0.4375 - {X} * {X}) / 2", f"ln(({X} * {X} + 3.0625) / ({X} * {X} + 0.0625)) / 4"), "asinh": (f"CASE WHEN {X} < 0 THEN -1 ELSE 1 END * acosh({C})", f"asin(0.75 / {C})"), "acosh": (f"acosh({A})", f"acos({B})"), "atanh": (f"ln((({X} + 1) * ({X} + 1) + 0.5625) / ((1 - {X}) * (1 - {X}) + 0.5625)) / 4", f"atan2(1.5, 0.4375 - {X} * {X}) / 2"),
}
on_values("complex_functions", _complex, {f"{k}_{p}": x for k, both in COMPLEX.items() for p, x in zip(("re", "im"), both)} | {"abs": R, "arg": T, "norm": f"{X} * {X} + 0.5625", "real": X, "imag": "0.75"})

# name, numerator and denominator before they are reduced, of m / 6 and -1 / 4
RATIOS = {"add": ("2 * m - 3", "12"), "subtract": ("2 * m + 3", "12"), "multiply": ("-m", "24"), "divide": ("-4 * m", "6")}
RATIO_TESTS = {k.removesuffix("_to"): op for k, op in COMPARED.items()}


def _ratios() -> dict[str, Column]:
    p, q, r = fn.ratio(F.col("v") % 100, F.lit(6)), fn.ratio(F.lit(-1), F.lit(4)), fn.ratio(F.lit(17), F.lit(2))
    exact = {f"{k}_{x}": getattr(fn, f"ratio_{k}")(p, q)[x] for k in RATIOS for x in ("num", "den")}
    return exact | {k: getattr(fn, f"ratio_{k}")(p, r) for k in RATIO_TESTS}


on_values(
    "ratio_functions",
    _ratios,
    {f"{k}_{x}": f"({a}) // gcd({num}, {den})".replace("m", "(v % 100)") for k, (num, den) in RATIOS.items() for x, a in (("num", num), ("den", den))}
    | {k: f"((v % 100) * 2 {op} 17 * 6)::INTEGER" for k, op in RATIO_TESTS.items()},
)
on_orders("gcd_lcm", lambda s: s.select("pos", fm.gcd(F.col("v"), F.col("pos")).alias("gcd"), fm.lcm(F.col("v") % 1000, F.col("pos")).alias("lcm")), "SELECT pos, gcd(v, pos) AS gcd, lcm(v % 1000, pos) AS lcm FROM o")


def _serial(s: DataFrame) -> DataFrame:
    a, joined = F.sequence(F.lit(1).cast("long"), F.col("v") % 6 + 1), lambda c: F.array_join(c.cast("array<string>"), ",")
    both = fn.inner_product(a, F.transform(a, lambda x: x * 2), F.lit(3).cast("long"))
    return s.select("pos", fn.accumulate(a, F.lit(10).cast("long")).alias("total"), both.alias("product"), joined(fn.partial_sum(a)).alias("sums"), joined(fn.iota(F.col("v") % 4, F.lit(5).cast("long"))).alias("iota"))


on_orders(
    "serial_numeric",
    _serial,
    "SELECT pos, CAST(10 + list_sum(range(1, v % 6 + 2)) AS BIGINT) AS total, CAST(3 + list_sum(list_transform(range(1, v % 6 + 2), lambda x: x * x * 2)) AS BIGINT) AS product,"
    " array_to_string(list_transform(range(1, v % 6 + 2), lambda x: x * (x + 1) // 2), ',') AS sums, array_to_string(range(5, 5 + v % 4), ',') AS iota FROM o",
)

# ---------------------------------------------------------------- random engines

#: Outputs that each query of an engine or a distribution draws.
DRAWN = 10_000


def congruential_sql(a: int, m: int = 2147483647, seed: int = 1) -> str:
    return f"WITH RECURSIVE g AS (SELECT 0 AS pos, {seed}::BIGINT * {a} % {m} AS v UNION ALL SELECT pos + 1, v * {a} % {m} FROM g WHERE pos < {DRAWN - 1}) SELECT CAST(pos AS BIGINT) AS pos, v FROM g"


def carry_sql(w: int, s: int, r: int, block: int = 1, used: int = 1, seed: int = 19780503) -> str:
    """Lagged subtraction step by step: the state is the lags, oldest first, and the borrow."""
    words, b = -(-w // 32), 1 << w
    step = f"list_slice(acc, 2, {r}) || [(acc[{r - s + 1}] - acc[1] - acc[{r + 1}] + {b}) % {b}, CASE WHEN acc[{r - s + 1}] - acc[1] - acc[{r + 1}] < 0 THEN 1 ELSE 0 END]"
    run = lambda n: f"list_reduce([st] || list_transform(range({n}), lambda k: [0::BIGINT]), lambda acc, k: {step})"
    part = " + ".join(f"(list_extract(e, {words} * k + {j + 1}) % 4294967296) * {1 << 32 * j}" for j in range(words))
    return f"""
WITH RECURSIVE seeds AS (SELECT 1 AS i, {seed % 2147483563}::BIGINT * 40014 % 2147483563 AS e UNION ALL SELECT i + 1, e * 40014 % 2147483563 FROM seeds WHERE i < {r * words}),
lags AS (SELECT list_transform(range({r}), lambda k: CAST(({part})::HUGEINT % {b} AS BIGINT)) AS x FROM (SELECT list(e::HUGEINT ORDER BY i) AS e FROM seeds)),
blocks AS (
  SELECT 0 AS n, x || [CASE WHEN x[{r}] = 0 THEN 1 ELSE 0 END] AS st FROM lags
  UNION ALL SELECT n + 1, {run(block)} FROM blocks WHERE n < {-(-DRAWN // used) - 1}),
drawn AS (SELECT n, unnest(range({used})) AS i, st FROM blocks)
SELECT CAST(n * {used} + i AS BIGINT) AS pos, v FROM (SELECT n, i, list_extract({run("i + 1")}, {r}) AS v FROM drawn) WHERE n * {used} + i < {DRAWN}"""


def philox_sql(w: int, constants: tuple[int, int, int, int], seed: int = 20111115, drawn: str = f"range({DRAWN})") -> str:
    """Ten rounds, each a step of nested queries; ``pos, v``."""
    top, kind = 1 << w, "UBIGINT" if w == 32 else "UHUGEINT"
    m0, c0, m1, c1 = constants
    k0, k1 = seed % top, 0
    high = f"(range // 4) // {top}" if w == 32 else "0"
    sql = f"SELECT range AS pos, CAST((range // 4) % {top if w == 32 else 1 << 62} AS {kind}) AS a, CAST({high} AS {kind}) AS b, 0::{kind} AS c, 0::{kind} AS d FROM {drawn}"
    for _ in range(10):
        sql = (
            f"SELECT pos, xor(xor((c * {m0}::{kind}) // {top}::{kind}, {k0}::{kind}), b) AS a, (c * {m0}::{kind}) % {top}::{kind} AS b,"
            f" xor(xor((a * {m1}::{kind}) // {top}::{kind}, {k1}::{kind}), d) AS c, (a * {m1}::{kind}) % {top}::{kind} AS d FROM ({sql})"
        )
        k0, k1 = (k0 + c0) % top, (k1 + c1) % top
    return f"SELECT pos, CAST(CASE pos % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END AS {'BIGINT' if w == 32 else 'DECIMAL(20,0)'}) AS v FROM ({sql})"


for _engine, _sql in {
    "minstd_rand0": congruential_sql(16807), "minstd_rand": congruential_sql(48271), "ranlux24_base": carry_sql(24, 10, 24), "ranlux48_base": carry_sql(48, 5, 12), "ranlux24": carry_sql(24, 10, 24, 223, 23), "ranlux48": carry_sql(48, 5, 12, 389, 11),
    "philox4x32": philox_sql(32, rnd.philox4x32().constants), "philox4x64": philox_sql(64, rnd.philox4x64().constants),
}.items():
    add(f"engine_{_engine}", lambda s, d, e=_engine: rnd.numbers(s, DRAWN, getattr(rnd, e)()), _sql)
for _engine in ("minstd_rand", "philox4x32"):
    add(
        f"engine_{_engine}_vec4",
        lambda s, d, e=_engine: rnd.vectors(s, DRAWN // 4, getattr(rnd, e)(), 4).select("pos", *[F.col("v")[i].alias(f"v{i}") for i in range(4)]),
        "SELECT pos // 4 AS pos, " + ", ".join(f"max(v) FILTER (WHERE pos % 4 = {i}) AS v{i}" for i in range(4)) + f" FROM ({ORACLE[f'engine_{_engine}']}) GROUP BY 1",
    )

# ---------------------------------------------------------------- distributions over the counter-based engine

U = f"WITH u AS (SELECT pos, v / 4294967296.0::DOUBLE AS u FROM ({philox_sql(32, rnd.philox4x32().constants)}))"
for _name, _op, _sql in (
    ("uniform_real", lambda u: rnd.uniform_real_distribution(u, -1.0, 3.0), "u * 4 - 1"),
    ("uniform_int", lambda u: rnd.uniform_int_distribution(u, 1, 6), "CAST(floor(u * 6 + 1) AS BIGINT)"),
    ("exponential", rnd.exponential_distribution, "-ln(1 - u)"),
    ("bernoulli", lambda u: rnd.bernoulli_distribution(u, 0.3), "u < 0.3::DOUBLE"),
    ("geometric", lambda u: rnd.geometric_distribution(u, 0.2), "CAST(floor(ln(1 - u) / ln(0.8)) AS BIGINT)"),
    ("weibull", lambda u: rnd.weibull_distribution(u, 2.0, 1.5), "1.5 * sqrt(-ln(1 - u))"),
    ("extreme_value", rnd.extreme_value_distribution, "-ln(-ln(1 - u))"),
    ("cauchy", rnd.cauchy_distribution, "tan(pi() * u)"),
):
    _exact = _name in ("uniform_int", "bernoulli", "geometric")
    add(
        f"distribution_{_name}",
        lambda s, d, f=_op, e=_exact: rnd.uniform(s.range(DRAWN).select(F.col("id").alias("pos")), rnd.philox4x32()).select("pos", (f(F.col("u")) if e else F.round(f(F.col("u")), 6) + 0.0).alias("v")),
        f"{U} SELECT pos, {_sql if _exact else f'round({_sql}, 6) + 0.0'} AS v FROM u",
    )
PAIRS = (
    f"WITH n AS (SELECT pos, v / 4294967296.0::DOUBLE AS u FROM ({philox_sql(32, rnd.philox4x32().constants)})),"
    " w AS (SELECT x.pos, sqrt(-2 * ln(x.u)) AS r, 2 * pi() * y.u AS t FROM n x JOIN n y ON y.pos = x.pos + 1 WHERE x.pos % 2 = 0), z AS (SELECT pos, r * sin(t) AS v FROM w UNION ALL SELECT pos + 1, r * cos(t) FROM w)"
)


def _normal(s: SparkSession) -> DataFrame:
    return s.range(DRAWN).select(F.col("id").alias("pos"))


add("distribution_normal", lambda s, d: rnd.normal_distribution(_normal(s), rnd.philox4x32()).select("pos", (F.round("v", 6) + 0.0).alias("v")), f"{PAIRS} SELECT pos, round(v, 6) + 0.0 AS v FROM z")
add("distribution_lognormal", lambda s, d: rnd.lognormal_distribution(_normal(s), rnd.philox4x32()).select("pos", (F.round("v", 6) + 0.0).alias("v")), f"{PAIRS} SELECT pos, round(exp(v), 6) + 0.0 AS v FROM z")

# ---------------------------------------------------------------- dynamic selection, kernel parameters


def _total(spark: SparkSession, d: str):
    return lambda pool: sel.in_pool(spark, pool, lambda: ag.reduce(prices(spark, d), 10).head().result)


def _long(spark: SparkSession, *values: int) -> DataFrame:
    return spark.createDataFrame([(int(x),) for x in values], "result long")


add("selection_select", lambda s, d: _long(s, _total(s, d)(sel.unwrap(sel.select(sel.RoundRobin(["a", "b"]))))), ORACLE["reduce"])
add("selection_submit", lambda s, d: _long(s, sel.wait(sel.submit(sel.RoundRobin(["a", "b"]), _total(s, d)))), ORACLE["reduce"])


def _group(spark: SparkSession, d: str) -> DataFrame:
    """Two submissions, waited for as one group or alone, give the same total."""
    policy = sel.DynamicLoad(["a", "b"])
    work = [sel.submit(policy, _total(spark, d)) for _ in sel.get_resources(policy)]
    sel.wait(sel.get_submission_group(policy))
    return _long(spark, *{sel.wait(x) for x in work})


add("selection_group", _group, ORACLE["reduce"])
add("selection_resources", lambda s, d: s.createDataFrame([(r,) for r in sel.get_resources(sel.FixedResource(["a", "b", "c"]))], "resource string"), "SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(resource)")


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """What the tuning policy selects after times were reported: the faster resource."""
    policy = sel.AutoTune(["slow", "fast"])
    for seconds in (9.0, 1.0):
        policy.report(sel.select(policy), "task_time", seconds)
    return spark.createDataFrame([(sel.unwrap(sel.select(policy)),)], "resource string")


add("selection_report", _reported, "SELECT 'fast' AS resource")
on_lines("kernel_param", lambda s: kernels.radix_sort(s, param=kernels.KernelParam(64, 64)), SORTED.format("", "l"))
