"""Mass and distribution functions of the discrete noises."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from quietframe.functions.exact import INFINITY, ExactNumber, ExactNumberInput, exp_bounds, ln_bounds


def double_sided_geometric_pmf(k, alpha):
    """Mass at k of noise with mass proportional to exp(-|k| / alpha)."""
    return np.tanh(0.5 / np.asarray(alpha, float)) * np.exp(-np.abs(k) / alpha)


def double_sided_geometric_cmf(k, alpha):
    """Mass up to k."""
    k = np.asarray(k, float)
    share = 1 / (1 + np.exp(-1 / alpha))
    return np.where(k >= 0, 1 - (1 - share) * np.exp(-np.maximum(k, 0) / alpha), share * np.exp(np.minimum(k, 0) / alpha))[()]


def double_sided_geometric_inverse_cmf(p, alpha):
    """The smallest k with at least mass p up to it."""
    p = np.asarray(p, float)
    share = 1 / (1 + np.exp(-1 / alpha))
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.ceil(-alpha * np.log((1 - p) / (1 - share)))
        low = np.ceil(alpha * np.log(p / share))
    k = np.where(p > share, high, low)
    # floating point may be one off at the edges
    k = np.where(double_sided_geometric_cmf(k - 1, alpha) >= p, k - 1, k)
    return np.where(double_sided_geometric_cmf(k, alpha) < p, k + 1, k)[()]


def double_sided_geometric_upper_tail(k: int, alpha: ExactNumberInput) -> Fraction:
    """A rational at or above the mass at k and beyond."""
    a = ExactNumber(alpha)
    if a == 0:
        return Fraction(int(k <= 0))
    if k <= 0:
        return Fraction(1)
    low = a.bounds()
    # mass at k and beyond for k >= 1 is exp(-k/a) / (1 + exp(-1/a)); both ends of alpha bound it
    top = exp_bounds(-Fraction(k) / low[1])[1] / (1 + exp_bounds(-1 / low[0])[0])
    return min(Fraction(1), top)


def double_sided_geometric_cmf_exact(k: ExactNumberInput, alpha: ExactNumberInput) -> ExactNumber:
    """The mass up to k, as a rational rounded down (so that what lies beyond is never understated)."""
    k, alpha = ExactNumber(k), ExactNumber(alpha)
    if alpha == INFINITY:
        return ExactNumber("1/2")
    whole = math.floor(k.to_fraction())
    if whole >= 0:
        return ExactNumber(1 - double_sided_geometric_upper_tail(whole + 1, alpha))
    low = alpha.bounds()
    below = exp_bounds(Fraction(whole) / low[0])[0] if alpha else Fraction(0)
    return ExactNumber(max(Fraction(0), below / (1 + exp_bounds(-1 / low[1])[1])) if alpha else 0)


def double_sided_geometric_inverse_cmf_exact(p: ExactNumberInput, alpha: ExactNumberInput) -> ExactNumber:
    """The smallest k whose mass up to it is certainly at least p."""
    p, alpha = ExactNumber(p), ExactNumber(alpha)
    if p >= 1:
        return INFINITY
    if alpha == 0 or p <= 0:
        return ExactNumber(0) if alpha == 0 else -INFINITY
    q = p.bounds()[0]
    guess = 0
    if 2 * q > 1:
        guess = math.ceil(-alpha.bounds()[1] * ln_bounds((1 - q) * 2)[0]) + 1
    else:
        guess = math.ceil(alpha.bounds()[0] * ln_bounds(2 * q)[1]) + 2
    while double_sided_geometric_cmf_exact(guess, alpha) < p:
        guess += 1
    while double_sided_geometric_cmf_exact(guess - 1, alpha) >= p:
        guess -= 1
    return ExactNumber(guess)


def _gaussian_table(sigma_squared: float) -> tuple[int, np.ndarray]:
    """Masses from -r to r; what lies beyond is below one in 10**40."""
    r = int(math.ceil(14 * math.sqrt(sigma_squared))) + 14
    k = np.arange(-r, r + 1, dtype=float)
    w = np.exp(-(k**2) / (2 * sigma_squared))
    return r, w / math.fsum(w)


def discrete_gaussian_pmf(k, sigma_squared: float):
    """Mass at k of noise with mass proportional to exp(-k**2 / (2 sigma_squared))."""
    _, w = _gaussian_table(sigma_squared)
    k = np.asarray(k, float)
    return (w[len(w) // 2] * np.exp(-(k**2) / (2 * sigma_squared)))[()]


def discrete_gaussian_cmf(k, sigma_squared: float):
    """Mass up to k; each tail is summed from its own end."""
    r, w = _gaussian_table(sigma_squared)
    k = np.floor(np.asarray(k, float))
    low = np.cumsum(w)
    at = np.clip(k, -r, r).astype(int) + r
    value = np.where(k < 0, low[at], 1 - np.append(low[::-1][1:], 0.0)[at])
    return np.where(k < -r, 0.0, np.where(k > r, 1.0, value))[()]


def discrete_gaussian_inverse_cmf(p, sigma_squared: float):
    """The smallest k with at least mass p up to it."""
    r, _ = _gaussian_table(sigma_squared)
    table = discrete_gaussian_cmf(np.arange(-r, r + 1), sigma_squared)
    return (np.searchsorted(table, np.asarray(p, float), "left") - r)[()]
