"""Tail probabilities of the t, F and chi-square distributions, for single numbers on the driver."""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-15
_STEPS = 2000


def _lentz(terms, start: float) -> float:
    """Modified Lentz evaluation of a continued fraction from its (a, b) terms."""
    f = start or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < _EPS:
            break
    return f


def _beta_terms(a: float, b: float, x: float):
    for m in range(_STEPS):
        if m:
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / (a * _lentz(_beta_terms(a, b, x), 1.0))


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        n = s
        while term > total * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    terms = ((-i * (i - s), x + 2 * i + 1 - s) for i in range(1, _STEPS))
    return front / _lentz(terms, x + 1.0 - s)


def t_two_sided(t: float, df: float) -> float:
    if df > 1e8:  # the normal limit; differences of large log gammas lose digits there
        return math.erfc(abs(t) / math.sqrt(2.0))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2.0, x / 2.0)
