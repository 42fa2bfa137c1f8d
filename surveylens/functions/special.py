"""Distribution tails for the statistics finishers.

These run on a handful of already-aggregated numbers (one row per ANOVA
factor, one per regression term), never on data rows. Pure Python; the
regularised incomplete beta function is evaluated with the continued
fraction expansion and the modified Lentz method.
"""

from __future__ import annotations

import math

_EPS = 1e-16
_TINY = 1e-300
_MAX_ITER = 10_000


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for I_x(a, b) (valid for x < (a + 1) / (a + b + 2))."""
    qab = a + b
    qap = a + 1.0
    qam = a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    if abs(d) < _TINY:
        d = _TINY
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        if abs(d) < _TINY:
            d = _TINY
        c = 1.0 + aa / c
        if abs(c) < _TINY:
            c = _TINY
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        if abs(d) < _TINY:
            d = _TINY
        c = 1.0 + aa / c
        if abs(c) < _TINY:
            c = _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) for a, b > 0 and 0 <= x <= 1."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float | None, dfn: float | None, dfd: float | None) -> float | None:
    """Upper tail P(F(dfn, dfd) > f); None when any input is undefined."""
    if f is None or dfn is None or dfd is None:
        return None
    if any(isinstance(v, float) and math.isnan(v) for v in (f, dfn, dfd)):
        return None
    if dfn <= 0 or dfd <= 0:
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    x = dfd / (dfd + dfn * f)
    return betainc_reg(dfd / 2.0, dfn / 2.0, x)


def t_sf(t: float, dof: float) -> float:
    """Upper tail P(T(dof) > t)."""
    x = dof / (dof + t * t)
    half = 0.5 * betainc_reg(dof / 2.0, 0.5, x)
    return half if t >= 0 else 1.0 - half


def t_two_sided_p(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


def t_ppf(q: float, dof: float) -> float:
    """Quantile of Student's t: the t with P(T <= t) = q (bisection + Newton polish)."""
    if not 0.0 < q < 1.0:
        raise ValueError("q must lie in (0, 1)")
    if dof <= 0:
        raise ValueError("dof must be positive")
    if q == 0.5:
        return 0.0
    target = 1.0 - q  # upper tail
    lo, hi = -1.0, 1.0
    while t_sf(lo, dof) < target:
        lo *= 2.0
    while t_sf(hi, dof) > target:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, dof) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)
