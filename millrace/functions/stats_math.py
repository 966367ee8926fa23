"""Distribution functions for test statistics, computed on the driver for single values."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float, level: float = 0.95) -> float:
    """The t that ``level`` of the distribution lies within, by bisection."""
    low, high = 0.0, 1e8
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def shapiro(values: list[float]) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's approximation (AS R94), for 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss = sum(v * v for v in m)
    a = [0.0] * n
    if n == 3:
        a[0], a[2] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        u = 1 / math.sqrt(n)
        poly = lambda cs: sum(c * u**k for k, c in enumerate(cs))
        # fixed values: the published polynomial coefficients
        an = poly((m[-1] / math.sqrt(ss), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056))
        if n > 5:
            am = poly((m[-2] / math.sqrt(ss), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * am**2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[1], a[-2], a[-1] = -an, -am, am, an
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[-1] = -an, an
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0, 1.0
    # fixed values: the published moments of the transformed statistic
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        y = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else 99.0
    else:
        k = math.log(n)
        mu = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sd = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        y = math.log(1 - w)
    return w, 1 - normal_cdf((y - mu) / sd)
