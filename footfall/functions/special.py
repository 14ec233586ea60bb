"""Vectorised special functions used inside tasks (numpy only)."""

from __future__ import annotations

import numpy as np

_SHIFT = 10
# Bernoulli terms of the Stirling series for ln Gamma and its derivatives.
_LN_GAMMA_TERMS = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_DIGAMMA_TERMS = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
_TRIGAMMA_TERMS = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def ln_gamma(z):
    """ln Gamma for positive arguments: Stirling series after an upward shift."""
    z = np.asarray(z, dtype=float)
    product = np.ones_like(z)
    for step in range(_SHIFT):
        product = product * np.where(z < _SHIFT, z + step, 1.0)
    y = np.where(z < _SHIFT, z + _SHIFT, z)
    inverse = 1.0 / y
    square = inverse * inverse
    series = np.zeros_like(y)
    for term in reversed(_LN_GAMMA_TERMS):
        series = series * square + term
    value = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series * inverse
    return value - np.log(product)


def digamma(z):
    """Derivative of ln Gamma for positive arguments."""
    z = np.asarray(z, dtype=float)
    low = z < _SHIFT
    head = np.zeros_like(z)
    for step in range(_SHIFT):
        head = head + np.where(low, 1.0 / (z + step), 0.0)
    y = np.where(low, z + _SHIFT, z)
    square = 1.0 / (y * y)
    series = np.zeros_like(y)
    for term in reversed(_DIGAMMA_TERMS):
        series = series * square + term
    return np.log(y) - 0.5 / y - series * square - head


def trigamma(z):
    """Second derivative of ln Gamma for positive arguments."""
    z = np.asarray(z, dtype=float)
    low = z < _SHIFT
    head = np.zeros_like(z)
    for step in range(_SHIFT):
        head = head + np.where(low, 1.0 / (z + step) ** 2, 0.0)
    inverse = 1.0 / np.where(low, z + _SHIFT, z)
    square = inverse * inverse
    series = np.zeros_like(inverse)
    for term in reversed(_TRIGAMMA_TERMS):
        series = series * square + term
    return inverse + 0.5 * square + series * square * inverse + head


def hyp2f1(a, b, c, z, max_terms: int = 2_000_000):
    """Gauss series for 0 <= z < 1 after Euler's transformation.

    Rows leave the loop as soon as their own terms stop mattering.
    """
    a, b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, c, z))
    p, q = c - a, c - b
    total = np.ones(z.shape)
    term = np.ones(z.shape)
    live = np.flatnonzero(z != 0.0)
    lp, lq, lc, lz = p.ravel()[live], q.ravel()[live], c.ravel()[live], z.ravel()[live]
    lt, ls = term.ravel()[live], total.ravel()[live]
    flat = total.ravel()
    for n in range(max_terms):
        if live.size == 0:
            break
        ratio = (lp + n) * (lq + n) / ((lc + n) * (n + 1.0)) * lz
        lt = lt * ratio
        ls = ls + lt
        # The tail is bounded by a geometric series once the ratio is below one.
        most = np.maximum(lz, np.abs(ratio))
        done = (most < 1.0) & (np.abs(lt) * most <= 1e-16 * np.abs(ls) * (1.0 - most))
        if done.any():
            flat[live[done]] = ls[done]
            keep = ~done
            live, lp, lq, lc, lz, lt, ls = (v[keep] for v in (live, lp, lq, lc, lz, lt, ls))
    if live.size:
        raise ArithmeticError("hypergeometric series did not converge")
    return (1.0 - z) ** (c - a - b) * flat.reshape(z.shape)


def regularised_beta(a: float, b: float, x: float) -> float:
    """Incomplete beta ratio I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = np.exp(
        ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - float(front) * _beta_fraction(b, a, 1.0 - x) / b
    return float(front) * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError("incomplete beta fraction did not converge")


def student_two_sided(t: float, df: float) -> float:
    return regularised_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper_tail(f: float, df1: float, df2: float) -> float:
    return regularised_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))
