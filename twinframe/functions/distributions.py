"""Tail probabilities and quantiles, applied after aggregation to one row per column."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-16


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / ((1.0 + step * d) or _TINY)
            c = (1.0 + step / c) or _TINY
            value *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            return value
    raise ArithmeticError(f"the incomplete beta fraction did not converge for {a}, {b}, {x}")


def incomplete_beta(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta at ``x``; ``rest`` is 1 - x, passed to keep its digits."""
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, rest) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t.

    Above 100,000 degrees of freedom a normal transform is used; its absolute error is below 1e-9 there.
    A fraction that does not converge raises.
    """
    if df > 1e5:  # error of the transform is of order 1 / df^2
        return normal_two_sided(abs(t) * (1.0 - 1.0 / (4.0 * df)) / math.sqrt(1.0 + t * t / (2.0 * df)))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def student_t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection on the two-sided tail."""
    if p < 0.5:
        return -student_t_quantile(1.0 - p, df)
    tail, low, high = 2.0 * (1.0 - p), 0.0, max(1.0, NormalDist().inv_cdf(p))
    while student_t_two_sided(high, df) > tail:
        low, high = high, high * 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        low, high = (middle, high) if student_t_two_sided(middle, df) > tail else (low, middle)
    return 0.5 * (low + high)


def chi_square_tail(x: float, df: float) -> float:
    """P(X >= x) for chi-square with ``df`` degrees of freedom.

    Above 2e7 degrees of freedom the Wilson-Hilferty transform is used; its absolute error is below
    1e-6 there. A fraction that does not converge raises.
    """
    if x <= 0.0:
        return 1.0
    if df > 2e7:  # Wilson-Hilferty; the error vanishes with 1 / df
        spread = 2.0 / (9.0 * df)
        return 1.0 - normal_cdf(((x / df) ** (1.0 / 3.0) - 1.0 + spread) / math.sqrt(spread))
    a, half = df / 2.0, x / 2.0
    front = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        place = a
        while term > total * _EPS:
            place += 1.0
            term *= half / place
            total += term
        return max(0.0, 1.0 - front * total)
    b = half + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for m in range(1, 1_000_000):
        step = -m * (m - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or _TINY)
        c = (b + step / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            return front * value
    raise ArithmeticError(f"the incomplete gamma fraction did not converge for {x}, {df}")


def _defined(function: Callable[..., float], *args: float) -> float:
    return float("nan") if any(math.isnan(a) for a in args) else function(*args)


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: _defined(normal_two_sided, v))


@F.pandas_udf(T.DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_defined(student_t_two_sided, a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_defined(student_t_quantile, a, b) for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_defined(chi_square_tail, a, b) for a, b in zip(x, df)], dtype="float64")
