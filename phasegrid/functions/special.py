"""Gamma-family special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8
#: from this shape on the uniform expansion is used; below it _TERMS terms of the series are enough
_UNIFORM = 500.0
_TERMS = 400
#: from here on differences of logarithms and digammas are taken from their own series
_LARGE = 50.0


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: shift by eight, then Stirling's series."""
    z = x + _SHIFT
    inv = 1 / z
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680))))
    stirling = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    return stirling - F.log(product)


def digamma(x: Column) -> Column:
    z = x + _SHIFT
    inv = 1 / z
    inv2 = inv * inv
    tail = F.log(z) - inv / 2 - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))
    for i in range(_SHIFT):
        tail = tail - 1 / (x + i)
    return tail


def trigamma(x: Column) -> Column:
    z = x + _SHIFT
    inv = 1 / z
    inv2 = inv * inv
    tail = inv + inv2 / 2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30)))
    for i in range(_SHIFT):
        tail = tail + 1 / ((x + i) * (x + i))
    return tail


def log_minus_digamma(a: Column) -> Column:
    """ln a - ψ(a); by its own series where the two are too close to subtract."""
    inv2 = 1 / (a * a)
    series = 0.5 / a + inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))
    return F.when(a > _LARGE, series).otherwise(F.log(a) - digamma(a))


def inverse_minus_trigamma(a: Column) -> Column:
    """1 / a - ψ'(a), likewise."""
    inv2 = 1 / (a * a)
    series = -inv2 * (0.5 + (1 / a) * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))))
    return F.when(a > _LARGE, series).otherwise(1 / a - trigamma(a))


def gamma_shape(s: Column, steps: int = 6) -> Column:
    """Solve ln a - ψ(a) = s by Newton steps from a closed-form start; NULL unless s > 0."""
    start = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)

    def newton(a: Column, _: Column) -> Column:
        better = a - (log_minus_digamma(a) - s) / inverse_minus_trigamma(a)
        return F.when(better > 0, better).otherwise(a / 2)

    return F.when(s > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton))


def _series_or_fraction(z: Column, shape: Column) -> Column:
    """P(shape, z) below _UNIFORM, where _TERMS terms reach double precision.

    Below shape + 1 the power series converges fast; above it the complement is
    a continued fraction, evaluated backwards.
    """
    front = F.exp(shape * F.log(z) - z - log_gamma(shape))

    def term(acc: Column, i: Column) -> Column:
        t = acc["t"] * z / (shape + i)
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    first = F.struct((1 / shape).alias("s"), (1 / shape).alias("t"))
    series = front * F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), first, term)["s"]

    def fraction(acc: Column, j: Column) -> Column:
        n = F.lit(_TERMS) - j + 1
        return (z + (2 * n - 1) - shape) - n * (n - shape) / acc

    depth = z + (2 * _TERMS + 1) - shape
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), depth, fraction)
    return F.when(z < shape + 1, series).otherwise(1 - front / tail)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(c)
    return out


# Taylor coefficients of the first three correction functions of the uniform expansion.
_CORRECTIONS = [
    [-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515, -571 / 261273600, -281 / 151559100,
     8.29671134095308601e-7, -1.76659527368260793e-7, 6.70785354340149857e-9],
    [-1 / 540, -1 / 288, 1 / 378, -77 / 77760, 2.05761316872427984e-4, -4.01877572016460905e-7, -1.80985503344899778e-5,
     7.64916091608111008e-6],
    [4.13359788359788360e-3, -2.68132716049382716e-3, 7.71604938271604938e-4, 2.00938786008230453e-6],
]


def _uniform(z: Column, shape: Column) -> Column:
    """P(shape, z) for a large shape: a normal tail and corrections in 1 / shape, uniform in z.

    Where the corrections' series would not converge, the tail is 0 or 1 anyway.
    """
    mu = (z - shape) / shape
    half = F.greatest(mu - F.log1p(F.greatest(mu, F.lit(-0.999999))), F.lit(0.0))
    eta = F.signum(mu) * F.sqrt(2 * half)
    y = shape * half  # half the square of the normal deviate
    # erfc of the deviate over the square root of 2 is Q(1/2, y)
    below = _series_or_fraction(F.greatest(y, F.lit(1e-300)), F.lit(0.5))
    normal = F.when(eta < 0, (1 - below) / 2).otherwise((1 + below) / 2)
    near = F.greatest(F.least(eta, F.lit(0.5)), F.lit(-0.5))
    c0, c1, c2 = (_polynomial(near, c) for c in _CORRECTIONS)
    rest = F.exp(-y) / F.sqrt(2 * F.lit(math.pi) * shape) * (c0 + (c1 + c2 / shape) / shape)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal - rest))


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    """Regularised lower incomplete gamma function P(shape, x / scale), for any shape."""
    z = x / scale
    small = F.least(shape, F.lit(_UNIFORM))  # keeps the branch that is not taken finite
    return (
        F.when(x.isNull() | shape.isNull(), F.lit(None).cast("double"))
        .when(z <= 0, F.lit(0.0))
        .when(shape > _UNIFORM, _uniform(z, shape))
        .otherwise(_series_or_fraction(z, small))
    )
