"""Tails of the chi-square and normal distributions without further libraries."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    cc, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        cc = b + an / cc or tiny
        step = d * cc
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * scale


def chi_square_upper(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable."""
    return gamma_q(df / 2, x / 2)


def chi_square_upper_column(x: Column, df: int) -> Column:
    """`chi_square_upper` of each value as an expression: a finite sum of exponential terms, and for odd ``df`` also the
    tail of the normal distribution. Null for null and NaN."""

    def tail(h: Column) -> Column:
        odd = df % 2
        term, total = (F.sqrt(h) * (2 / math.sqrt(math.pi)), F.lit(0.0)) if odd else (F.lit(1.0), F.lit(0.0))
        for k in range((df - 1) // 2 if odd else df // 2):
            total = total + term
            term = term * h / (k + 1.5 if odd else k + 1)
        whole = F.exp(-h) * total
        # from 1500 on a tail is under the smallest double for any df that is written out like this
        return F.when(h <= 0, 1.0).when(h > 1500 + df, 0.0).otherwise(F.least(F.lit(1.0), erfc_column(F.sqrt(h)) + whole if odd else whole))

    # as the element of an array the value is computed once, however often the formula names it
    h = F.when(~F.isnan(x), x / 2)
    return F.get(F.transform(F.array(h), lambda v: F.when(v.isNotNull(), tail(v))), F.lit(0))


def erfc_column(z: Column) -> Column:
    """erfc of values from 0 on, as an expression: 1 less a series below 2, a continued fraction above."""
    series = F.lit(1.0)
    for n in range(34, 0, -1):
        series = F.lit(1.0) + series * z * z * (2 / (2 * n + 1))
    fraction = z
    for n in range(44, 0, -1):
        fraction = z + F.lit(n / 2) / fraction
    return F.when(z < 2, F.lit(1.0) - F.exp(-z * z) * z * series * (2 / math.sqrt(math.pi))).otherwise(F.exp(-z * z) / (fraction * math.sqrt(math.pi)))


def chi_square_quantile(p: float, df: int) -> float:
    """The value below which a chi-square variable lies with probability p, by bisection."""
    lo, hi = 0.0, float(max(df, 1))
    while 1 - chi_square_upper(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - chi_square_upper(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) by Royston's approximation (AS R94) for 4 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=np.float64))
    n = len(x)
    if not 4 <= n <= 5000:
        raise ValueError("Shapiro-Wilk takes 4 to 5000 values")
    if x[0] == x[-1]:
        raise ValueError("all values are equal")
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.empty(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ssq)], u)
    if n > 5:
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ssq)], u)
        phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[[0, 1, -2, -1]] = -last, -before, before, last
    else:
        phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[[0, -1]] = -last, last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - math.log(max(1 - w, 1e-19)), 1e-19))
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y, ln = math.log(max(1 - w, 1e-19)), math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 1 - normal.cdf((y - mu) / sigma)
