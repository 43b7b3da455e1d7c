"""Interval and p-value expressions."""

from __future__ import annotations

import types

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

Z95 = 1.96


def rate(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(0.0))


def rounded(value: Column, decimals: int) -> Column:
    """Rounded after scaling, halves to even."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """Wilson score interval in percent as ``struct<lo, hi>``; (0, 0) for an empty total."""
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    z2 = z * z
    scale = F.try_divide(F.lit(1.0), F.lit(1.0) + F.try_divide(F.lit(z2), n))
    centre = p + F.try_divide(F.lit(z2), n * 2)
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), n * 4), n))
    lo = F.greatest(F.lit(0.0), (centre - spread) * scale) * 100
    hi = F.least(F.lit(1.0), (centre + spread) * scale) * 100
    empty = F.coalesce(total, F.lit(0)) == 0
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(lo).alias("lo"),
        F.when(empty, F.lit(0.0)).otherwise(hi).alias("hi"),
    )


def beta_cdf(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function I_x(a, b), y being 1 - x, by its contracted continued fraction.

    Everything that would cancel for large a and b is written with a y - b x, and the factor in front as
    exp(-deviance) with Stirling remainders. Raises ArithmeticError if the fraction doesn't converge.
    """
    import math

    def fraction(a: float, b: float, x: float, y: float, off: float) -> float:
        """The even part of the fraction, off = a y - b x >= 0: 1 / (b0 + a1 / (b1 + a2 / (b2 + ...)))."""

        def whole(m: int) -> float:
            # a - (a + b) x and the like are joined before they can cancel.
            last = (a + m) / (a + 2 * m + 1) * (off + 1 + m * (1 + y))
            return m + m * (b - m) * x / (a + 2 * m - 1) + last if m else last

        out = c = whole(0)
        d = 0.0
        # Near the mean it takes some multiple of the square root of a + b.
        for m in range(1, 1000 + int(20 * math.sqrt(a + b))):
            alpha = (a + m - 1) * (a + b + m - 1) * m * (b - m) * x * x / (a + 2 * m - 1) ** 2
            beta = whole(m)
            d = 1.0 / (beta + alpha * d)
            c = beta + alpha / c
            out *= c * d
            if abs(c * d - 1.0) < 1e-15:
                return 1.0 / out
        raise ArithmeticError(f"no convergence for I_{x}({a}, {b})")

    def remainder(z: float) -> float:
        """lgamma(z) less its leading Stirling terms."""
        if z < 10:
            return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
        return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)

    def excess(u: float) -> float:
        """(1 + u) log(1 + u) - u"""
        if abs(u) > 0.1:
            return (1 + u) * math.log1p(u) - u if u > -1 else 1.0
        total, term, k = 0.0, u * u, 2
        while abs(term) > 1e-18 * abs(total) and k < 40:
            total += term / (k * (k - 1))
            term, k = -term * u, k + 1
        return total

    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    n, off = a + b, a * y - b * x
    deviance = n * x * excess(off / (n * x)) + n * y * excess(-off / (n * y))
    front = math.exp(remainder(n) - remainder(a) - remainder(b) - deviance) * math.sqrt(a * b / (2 * math.pi * n))
    if off >= 0:
        return front * fraction(a, b, x, y, off)
    return 1.0 - front * fraction(b, a, y, x, -off)


def _by_value(fn):
    """A copy of ``fn`` that pickles by value, so executors need no copy of this package."""
    return types.FunctionType(fn.__code__, {"__builtins__": __builtins__, "__name__": "__main__"})


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t. Meant for aggregated rows, one per group."""
    cdf = _by_value(beta_cdf)

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series(
            [cdf(v / 2.0, 0.5, v / (v + x * x), x * x / (v + x * x)) if x == x and v > 0 else None for x, v in zip(t, df)],
            dtype="float64",
        )

    return F.pandas_udf(p, T.DoubleType())(t, df)


def mcnemar_pvalue(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p from the two discordant counts, in closed form.

    min(1, 2 P(X <= min(b, c))) for X ~ Binomial(b + c, 1/2). Meant for aggregated rows.
    """
    cdf = _by_value(beta_cdf)

    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        import pandas

        def one(n: int, low: int) -> float:
            return 1.0 if 2 * low >= n else min(1.0, 2.0 * cdf(n - low, low + 1, 0.5, 0.5))

        return pandas.Series(
            [one(int(x) + int(y), int(min(x, y))) for x, y in zip(b, c)], dtype="float64"
        )

    return F.pandas_udf(p, T.DoubleType())(b, c)
