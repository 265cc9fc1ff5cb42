"""Random engines whose k-th output depends on seed and position alone, and distributions over them.

Every engine is a function of ``pos``: partitions start anywhere without generating what comes before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


@dataclass(frozen=True)
class LinearCongruential:
    """x(k) = a^(k+1) seed mod m, by modular powers."""

    a: int
    m: int = 2147483647
    seed: int = 1
    kind: str = "long"

    @property
    def low(self) -> int:
        return 1

    @property
    def high(self) -> int:
        return self.m - 1

    def at(self, pos: np.ndarray) -> np.ndarray:
        e = pos.astype(U) + U(1)
        out, base, m = np.full(len(e), self.seed % self.m or 1, U), self.a % self.m, U(self.m)
        for bit in range(64):
            on = (e >> U(bit)) & U(1) == 1
            out[on] = out[on] * U(base) % m
            base = base * base % self.m
            if not (e >> U(bit)).any():
                break
        return out


@dataclass(frozen=True)
class Philox:
    """Counter-based: four words of ``w`` bits from each counter value, ten rounds."""

    w: int
    constants: tuple[int, int, int, int]
    seed: int = 20111115

    @property
    def kind(self) -> str:
        return "long" if self.w == 32 else "decimal(20,0)"

    low = 0

    @property
    def high(self) -> int:
        return (1 << self.w) - 1

    def _multiply(self, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        if self.w == 32:
            full = x * U(c)
            return full >> U(32), full & U(0xFFFFFFFF)
        half = U(0xFFFFFFFF)
        a, b, d, e = x >> U(32), x & half, U(c >> 32), U(c & 0xFFFFFFFF)
        low = b * e
        mid = a * e + (low >> U(32))
        cross = b * d + (mid & half)
        return a * d + (mid >> U(32)) + (cross >> U(32)), x * U(c)

    def at(self, pos: np.ndarray) -> np.ndarray:
        mask = U(self.high)
        block = (pos // 4).astype(U)
        x = [block & mask, (block >> U(32)) if self.w == 32 else np.zeros(len(block), U), np.zeros(len(block), U), np.zeros(len(block), U)]
        m0, c0, m1, c1 = self.constants
        k0, k1 = self.seed & self.high, 0
        for _ in range(10):
            h0, l0 = self._multiply(x[2], m0)
            h1, l1 = self._multiply(x[0], m1)
            x = [h0 ^ U(k0) ^ x[1], l0, h1 ^ U(k1) ^ x[3], l1]
            k0, k1 = (k0 + c0) & self.high, (k1 + c1) & self.high
        return np.choose((pos % 4).astype(int), x)


@dataclass(frozen=True)
class SubtractWithCarry:
    """Lagged subtraction with borrow, run as the congruential sequence it is equivalent to.

    With b = 2^w and M = b^r - b^s + 1, the state y moves by y -> y / b mod M and gives -y mod b.
    """

    w: int
    s: int
    r: int
    seed: int = 19780503
    kind: str = "long"

    low = 0

    @property
    def high(self) -> int:
        return (1 << self.w) - 1

    def _first(self) -> int:
        """The state after seeding with the standard generator of seeds."""
        e, words = (self.seed % 2147483563) or 1, -(-self.w // 32)
        lags = []
        for _ in range(self.r):
            z = 0
            for j in range(words):
                e = e * 40014 % 2147483563
                z |= (e & 0xFFFFFFFF) << 32 * j
            lags.append(z & self.high)
        carry = int(lags[-1] == 0)
        return sum(x << self.w * j for j, x in enumerate(lags)) - sum(x << self.w * j for j, x in enumerate(lags[self.r - self.s :])) + carry

    def walk(self, start: int, count: int) -> Iterator[int]:
        b = 1 << self.w
        m = (1 << self.w * self.r) - (1 << self.w * self.s) + 1
        y = self._first() % m * pow(pow(b, -1, m), start, m) % m
        for _ in range(count):
            x = -y % b
            yield x
            y = (y + x * m) >> self.w

    def at(self, pos: np.ndarray) -> np.ndarray:
        if not len(pos):
            return np.zeros(0, U)
        low, high = int(pos.min()), int(pos.max())
        if high - low < 4 * len(pos) + 1024:
            return np.fromiter(self.walk(low, high - low + 1), U)[pos - low]
        return np.array([next(self.walk(int(p), 1)) for p in pos], U)


@dataclass(frozen=True)
class DiscardBlock:
    """Of each ``block`` outputs the first ``used``."""

    base: SubtractWithCarry
    block: int
    used: int
    kind: str = "long"

    low = 0

    @property
    def high(self) -> int:
        return self.base.high

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.base.at(pos // self.used * self.block + pos % self.used)


def minstd_rand0(seed: int = 1) -> LinearCongruential:
    return LinearCongruential(16807, seed=seed)


def minstd_rand(seed: int = 1) -> LinearCongruential:
    return LinearCongruential(48271, seed=seed)


default_engine = minstd_rand


def ranlux24_base(seed: int = 19780503) -> SubtractWithCarry:
    return SubtractWithCarry(24, 10, 24, seed)


def ranlux48_base(seed: int = 19780503) -> SubtractWithCarry:
    return SubtractWithCarry(48, 5, 12, seed)


def ranlux24(seed: int = 19780503) -> DiscardBlock:
    return DiscardBlock(ranlux24_base(seed), 223, 23)


def ranlux48(seed: int = 19780503) -> DiscardBlock:
    return DiscardBlock(ranlux48_base(seed), 389, 11)


# fixed values: multipliers and round constants of the published generators
def philox4x32(seed: int = 20111115) -> Philox:
    return Philox(32, (0xCD9E8D57, 0x9E3779B9, 0xD2511F53, 0xBB67AE85), seed)


def philox4x64(seed: int = 20111115) -> Philox:
    return Philox(64, (0xCA5A826395121157, 0x9E3779B97F4A7C15, 0xD2E7470EE14C6C93, 0xBB67AE8584CAA73B), seed)


def outputs(s: DataFrame, engine, name: str = "v", lane: int = 0, lanes: int = 1) -> DataFrame:
    """Add output ``pos * lanes + lane`` of ``engine`` to every row of a sequence."""
    schema = s.schema.add(name, engine.kind) if name not in s.columns else s.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = engine.at(pdf["pos"].to_numpy(np.int64) * lanes + lane)
            pdf[name] = [Decimal(int(v)) for v in x] if engine.kind.startswith("decimal") else x.astype(np.int64)
            yield pdf

    return s.select("*").mapInPandas(draw, fields)


def numbers(spark: SparkSession, n: int, engine, start: int = 0) -> DataFrame:
    """``pos, v``: outputs ``start`` to ``start + n - 1``."""
    out = outputs(spark.range(start, start + n).select(F.col("id").alias("pos")), engine)
    return out.withColumn("pos", F.col("pos") - start) if start else out


def vectors(spark: SparkSession, n: int, engine, width: int) -> DataFrame:
    """``pos, v``: the vector forms of the engines, ``width`` consecutive outputs a row, drawn by one Python worker a task."""
    schema = f"pos long, v array<{engine.kind}>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(0).to_numpy()
            x = engine.at((pos[:, None] * width + np.arange(width)).ravel())
            flat = pa.array([Decimal(int(v)) for v in x], pa.decimal128(20, 0)) if engine.kind.startswith("decimal") else pa.array(x.astype(np.int64))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["pos", "v"])

    return spark.range(n).select(F.col("id").alias("pos")).mapInArrow(draw, schema)


# Distributions.  ``u`` is a uniform column in [0, 1), see `uniform`.


def uniform(s: DataFrame, engine, name: str = "u", lane: int = 0, lanes: int = 1) -> DataFrame:
    out = outputs(s, engine, "_x", lane, lanes)
    return out.withColumn(name, (F.col("_x").cast("double") - engine.low) / (float(engine.high - engine.low) + 1.0)).drop("_x")


def uniform_real_distribution(u: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return u * (b - a) + a


def uniform_int_distribution(u: Column, a: int = 0, b: int = 2147483647) -> Column:
    """The uniform real on [a, b + 1), truncated."""
    x = u * (float(b) + 1.0 - float(a)) + float(a)
    return (F.signum(x) * F.floor(F.abs(x))).cast("long")


def normal_distribution(s: DataFrame, engine, mean: float = 0.0, stddev: float = 1.0, name: str = "v") -> DataFrame:
    """Box-Muller pairs: positions 2i and 2i + 1 are the sine and cosine of the same two uniforms."""
    both = s.withColumns({"_old": F.col("pos"), "pos": F.floor(F.col("pos") / 2)})
    both = uniform(uniform(both, engine, "_u1", 0, 2), engine, "_u2", 1, 2).withColumn("pos", F.col("_old"))
    log = F.when(F.col("_u1") == 0, F.lit(math.log(5e-324))).otherwise(F.log("_u1"))
    angle = F.lit(2 * math.pi) * F.col("_u2")
    wave = F.when(F.col("pos") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
    return both.withColumn(name, mean + stddev * F.sqrt(-2.0 * log) * wave).drop("_u1", "_u2", "_old")


def lognormal_distribution(s: DataFrame, engine, mean: float = 0.0, stddev: float = 1.0, name: str = "v") -> DataFrame:
    return normal_distribution(s, engine, mean, stddev, name).withColumn(name, F.exp(name))


def exponential_distribution(u: Column, rate: float = 1.0) -> Column:
    return -F.log(1.0 - u) / rate


def bernoulli_distribution(u: Column, p: float = 0.5) -> Column:
    return u < p


def geometric_distribution(u: Column, p: float = 0.5) -> Column:
    return F.floor(F.log(1.0 - u) / math.log(1.0 - p)).cast("long")


def weibull_distribution(u: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return b * F.pow(-F.log(1.0 - u), F.lit(1.0 / a))


def extreme_value_distribution(u: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return a - b * F.log(-F.log(1.0 - u))


def cauchy_distribution(u: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return a + b * F.tan(F.lit(math.pi) * u)
