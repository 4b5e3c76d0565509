"""Distribution functions in numpy, for p-values: there is no statistics library here."""

from __future__ import annotations

import math

import numpy as np


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction (modified Lentz) on its convergent side."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: the series below a + 1, the continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * f


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of the normal distribution function by Newton steps from a logistic guess."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    z = math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        step = ((1 - normal_sf(z)) - p) / (math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return z


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 and not math.isnan(t) else math.nan


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 else math.nan


def chi2_p(x: float, df: float) -> float:
    return 1 - gamma_cdf(df / 2, x / 2) if df > 0 else math.nan


def shapiro_ends(n: int, mm: float, last: float, second: float) -> tuple[float, float, float]:
    """Royston's weights of the greatest and (above 5) the next of n values, and the square of what divides the normal scores of those between; mm is the
    sum of squares of all scores, last and second are the greatest two."""
    u = 1 / math.sqrt(n)
    # The coefficients of the published polynomials.
    one = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, last / math.sqrt(mm)], u)
    two = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, second / math.sqrt(mm)], u)
    return float(one), float(two), float((mm - 2 * last**2 - 2 * second**2) / (1 - 2 * one**2 - 2 * two**2))


def shapiro(values) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk by Royston's approximation of 1995, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("the test is for 3 to 5000 values")
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, a = float(m @ m), np.empty(n)
    last, second, phi = shapiro_ends(n, mm, m[-1], m[-2])
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    elif n <= 5:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[:] = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    else:
        a[:] = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    """p of W for n values. The approximation was fitted up to 5000 values and is carried on beyond."""
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        y = -math.log(max(gamma - math.log1p(-w), 1e-300)) if gamma > math.log1p(-w) else math.inf
    else:
        k = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
        y = math.log1p(-w) if w < 1 else -math.inf
    return normal_sf((y - mu) / sigma)
