"""Numeric and probability functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int | float) else x


def round_unit(x, unit: float = 1.0) -> Column:
    """To the next multiple of ``unit``, halves away from zero."""
    return F.round(_c(x) / unit) * unit


def integer(x) -> Column:
    """Towards zero."""
    return F.when(_c(x) < 0, F.ceil(_c(x))).otherwise(F.floor(_c(x)))


def modulo(x, y) -> Column:
    """Null for a zero divisor."""
    return _c(x) % F.nullif(_c(y), F.lit(0))


def log(x) -> Column:
    """Null where x is not positive."""
    return F.when(_c(x) > 0, F.ln(_c(x)))


def pdf_normal(x, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (_c(x) - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often the body names it."""
    return F.transform(F.array(x), body)[0]


def probnorm(x) -> Column:
    """Standard normal distribution function: a series near 0, a continued fraction in the tails."""

    def upper(a: Column) -> Column:
        # Phi(a) = 1/2 + pdf(a) * (a + a^3/3 + a^5/(3*5) + ...), 60 terms by Horner's rule
        falling = lambda n: F.sequence(F.lit(n), F.lit(1))
        series = F.aggregate(falling(60), F.lit(1.0), lambda acc, k: 1 + a * a / (2 * k + 1) * acc)
        frac = F.aggregate(falling(40), a, lambda acc, k: a + k / acc)
        return F.when(a < 4, 0.5 - pdf_normal(a) * a * series).otherwise(pdf_normal(a) / frac)

    return let(_c(x).cast("double"), lambda v: let(let(F.abs(v), upper), lambda tail: F.when(v >= 0, 1 - tail).otherwise(tail)))


def probit(p) -> Column:
    """Inverse of probnorm: a rational start, then two Newton steps; null outside 0 < p < 1."""

    def solve(p: Column) -> Column:
        # The rational start of Abramowitz and Stegun 26.2.23
        start = lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
        z = let(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), lambda t: F.when(p < 0.5, -start(t)).otherwise(start(t)))
        for _ in range(2):
            z = let(z, lambda v: v - (probnorm(v) - p) / pdf_normal(v))
        return F.when((p > 0) & (p < 1), z)

    return let(_c(p).cast("double"), solve)


def absolute(x) -> Column:
    return F.abs(_c(x))


def ceil(x) -> Column:
    return F.ceil(_c(x))


def floor(x) -> Column:
    return F.floor(_c(x))


def sign(x) -> Column:
    return F.signum(_c(x))


def sqrt(x) -> Column:
    """Null below 0."""
    return F.when(_c(x) >= 0, F.sqrt(_c(x)))


def log2(x) -> Column:
    return F.when(_c(x) > 0, F.log2(_c(x)))


def log10(x) -> Column:
    return F.when(_c(x) > 0, F.log10(_c(x)))


def exp(x) -> Column:
    return F.exp(_c(x))


def largest(*xs) -> Column:
    """Row-wise maximum that skips nulls."""
    return F.greatest(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def smallest(*xs) -> Column:
    return F.least(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def uniform(key, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, so that splits come out the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(_c(key), F.lit(seed)), 11) / float(1 << 53)


def gamma_ln(x) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series, after a shift by eight."""

    def series(v: Column) -> Column:
        z = v + 8
        # Coefficients of Stirling's series
        tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
        down = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, k: acc + F.ln(v + k))
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail - down

    return let(_c(x).cast("double"), series)


def gamma_p(a, x) -> Column:
    """Regularised lower incomplete gamma function: its series below a + 1, a continued fraction beyond."""
    a, x = _c(a).cast("double"), _c(x).cast("double")
    front = F.exp(a * F.ln(x) - x - gamma_ln(a))
    down = lambda n: F.sequence(F.lit(n), F.lit(1))
    series = F.aggregate(down(200), F.lit(1.0), lambda acc, k: 1 + x / (a + k) * acc) / a
    frac = F.aggregate(down(200), x, lambda acc, k: x + (k - a) / (1 + k / acc))
    return F.when(x <= 0, 0.0).when(x < a + 1, front * series).otherwise(1 - front / frac)


def beta_i(a, b, x) -> Column:
    """Regularised incomplete beta function, by the continued fraction on the side where it converges fast."""

    def part(a: Column, b: Column, x: Column) -> Column:
        front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + gamma_ln(a + b) - gamma_ln(a) - gamma_ln(b)) / a
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        inner = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda acc, m: 1 + even(m) / (1 + odd(m) / acc))
        return front / (1 + odd(F.lit(0)) / inner)

    a, b, x = (_c(v).cast("double") for v in (a, b, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), part(a, b, x)).otherwise(1 - part(b, a, 1 - x))


def probchi(x, df) -> Column:
    return gamma_p(_c(df) / 2, _c(x) / 2)


def probf(x, d1, d2) -> Column:
    x, d1, d2 = _c(x), _c(d1), _c(d2)
    return F.when(x <= 0, 0.0).otherwise(beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)))


def probt(x, df) -> Column:
    x, df = _c(x).cast("double"), _c(df)
    tail = 0.5 * beta_i(df / 2, F.lit(0.5), df / (df + x * x))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _inverse(cdf, p: Column, lo: float, hi: float) -> Column:
    """The x in [lo, hi] with cdf(x) = p, by 60 halvings."""
    step = lambda acc, _: let((acc["lo"] + acc["hi"]) / 2, lambda m: F.when(cdf(m) < p, F.struct(m.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), m.alias("hi"))))
    got = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), step)
    return F.when((p > 0) & (p < 1), (got["lo"] + got["hi"]) / 2)


def cinv(p, df) -> Column:
    return _inverse(lambda x: probchi(x, df), _c(p), 0.0, 1e4)


def tinv(p, df) -> Column:
    return _inverse(lambda x: probt(x, df), _c(p), -1e4, 1e4)


def finv(p, d1, d2) -> Column:
    return _inverse(lambda x: probf(x, d1, d2), _c(p), 0.0, 1e5)
