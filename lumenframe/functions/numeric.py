"""Math functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit
TINY = 1.1754943508222875e-38


def ispow2(x: Column) -> Column:
    return (x >= 0) & (x.bitwiseAND(x - 1) == 0)


def ceil2(x: Column) -> Column:
    """The next power of two; 1 below 1.  By smearing bits, so that no rounding of logarithms can matter."""
    v = F.greatest(x.cast("long"), lit(1)) - 1
    for k in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftright(v, k))
    return v + 1


def floor2(x: Column) -> Column:
    v = F.greatest(x.cast("long"), lit(0))
    for k in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftright(v, k))
    return v - F.shiftright(v, 1)


def round_to_multiple(x: Column, m: Column | int) -> Column:
    return F.ceil(x / m) * m


def safe_mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0).otherwise(a % F.when(b != 0, b))


def safe_fmod(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a % F.when(b != 0, b))


def clamp(v: Column, lo, hi) -> Column:
    return F.when(F.isnan(v), lit(lo)).otherwise(F.least(F.greatest(v, lit(lo)), lit(hi)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def bilerp(a: Column, b: Column, c: Column, d: Column, s: Column, t: Column) -> Column:
    return lerp(lerp(a, b, s), lerp(c, d, s), t)


def trilerp(v: list[Column], s: Column, t: Column, r: Column) -> Column:
    return lerp(bilerp(*v[:4], s, t), bilerp(*v[4:], s, t), r)


def floorfrac(x: Column) -> tuple[Column, Column]:
    return F.floor(x), x - F.floor(x)


def sign(x: Column) -> Column:
    return F.when(x < 0, -1.0).otherwise(1.0)


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, lit(0.0)))


def safe_inversesqrt(x: Column) -> Column:
    return F.when(x > 0, 1 / F.sqrt(F.when(x > 0, x))).otherwise(0.0)


def safe_asin(x: Column) -> Column:
    return F.asin(clamp(x, -1.0, 1.0))


def safe_acos(x: Column) -> Column:
    return F.acos(clamp(x, -1.0, 1.0))


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, lit(TINY)))


def safe_log2(x: Column) -> Column:
    return F.log2(F.greatest(x, lit(TINY)))


def safe_log10(x: Column) -> Column:
    return F.log10(F.greatest(x, lit(TINY)))


def safe_logb(x: Column) -> Column:
    """The exponent of |x|; that of the least normal float for 0."""
    return F.when(x == 0, -126.0).otherwise(F.floor(F.log2(F.when(x != 0, F.abs(x)))))


def safe_pow(x: Column, y: Column) -> Column:
    """0 to 0 is 1; 0 and negative bases with a fractional exponent give 0; bounded by the largest float."""
    big = 3.4028234663852886e38
    fine = (x > 0) | ((x < 0) & (y == F.floor(y)))
    return F.when(y == 0, 1.0).when(fine, F.least(F.greatest(F.pow(F.when(fine, x), y), lit(-big)), lit(big))).otherwise(0.0)


def fast_erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def fast_erfc(x: Column) -> Column:
    return 1 - fast_erf(x)


def fast_ierf(x: Column) -> Column:
    """Winitzki's inverse of erf; x is held inside (-1, 1)."""
    a = 0.147
    ln = F.log(1 - F.pow(clamp(x, -0.99999994, 0.99999994), lit(2.0)))
    b = 2 / (math.pi * a) + ln / 2
    return F.signum(x) * F.sqrt(F.sqrt(b * b - ln / a) - b)


def interpolate_linear(x: Column, knots: list[float]) -> Column:
    """Piecewise linear over evenly spaced knots on [0, 1]."""
    last = len(knots) - 1
    t = clamp(x, 0.0, 1.0) * last
    i = F.least(F.floor(t), lit(last - 1)).cast("int")
    table = F.array(*[lit(float(k)) for k in knots])
    return lerp(F.get(table, i), F.get(table, i + 1), t - i)


def quantize(v: Column, bits: int, signed: bool = False) -> Column:
    """A normalised value as an integer: scaled, half a step away from zero, cut and clamped."""
    top = float((1 << (bits - signed)) - 1)
    low = -float(1 << (bits - 1)) if signed else 0.0
    s = v * top
    # Adds half a step by sign, clamps, and cuts towards zero.
    s = F.when(F.isnan(s), lit(low)).otherwise(F.least(F.greatest(s + F.when(s < 0, -0.5).otherwise(0.5), lit(low)), lit(top)))
    return F.when(s < 0, F.ceil(s)).otherwise(F.floor(s)).cast("long")


def dequantize(v: Column, bits: int, signed: bool = False) -> Column:
    return v / float((1 << (bits - signed)) - 1)


def sincos(x: Column) -> Column:
    """Sine and cosine together."""
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


def fast_safe_pow(x: Column, y: Column) -> Column:
    """A power that is never undefined: 1 for a power of 0, 0 of 0, and of negative numbers only whole powers."""
    whole = F.floor(y) == y
    odd = F.abs(F.pmod(y, F.lit(2.0))) == 1
    size = F.least(F.pow(F.abs(x), y), F.lit(3.4028234663852886e38))
    return F.when(y == 0, 1.0).when(x == 0, 0.0).when(y == 1, x).when(y == 2, F.least(x * x, F.lit(3.4028234663852886e38))).when(x > 0, size).when(whole, F.when(odd, -size).otherwise(size)).otherwise(0.0)
