"""Samplers that draw from the operating system's entropy and hold exactly.

Discrete samplers follow Canonne, Kamath and Steinke, "The Discrete Gaussian for
Differential Privacy" (2020): only integer and rational arithmetic decides.
Continuous samplers evaluate an inverse distribution function on an interval of
the uniform variable and draw more bits until all of it rounds to one float.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

from quietframe.functions.interval import Interval, erfinv, precision

_draw = secrets.randbelow


def prng():
    """A numpy generator seeded with fresh system entropy, for tests and tools; noise itself never uses it."""
    import numpy as np

    return np.random.default_rng(secrets.randbits(256))


class RNGWrapper:
    """Unbiased whole numbers of any size from a source of bits (system entropy unless another is given)."""

    def __init__(self, getrandbits: Callable[[int], int] = secrets.randbits):
        self._bits = getrandbits

    def randrange(self, stop: int) -> int:
        """A uniform integer in [0, stop): draws of enough bits, those beyond the end again."""
        if stop <= 0:
            raise ValueError("The range is empty.")
        size = (stop - 1).bit_length()
        while True:
            value = self._bits(size) if size else 0
            if value < stop:
                return value


def uniform_below(m: int) -> int:
    """A uniform integer in [0, m)."""
    return _draw(m)


def bernoulli(p: Fraction) -> int:
    """1 with probability p."""
    return int(_draw(p.denominator) < p.numerator)


def bernoulli_exp(x: Fraction) -> int:
    """1 with probability exp(-x), x >= 0."""
    while x > 1:
        if not _bernoulli_exp_unit(Fraction(1)):
            return 0
        x -= 1
    return _bernoulli_exp_unit(x)


def _bernoulli_exp_unit(x: Fraction) -> int:
    # the first k at which a Bernoulli(x/k) fails is odd with probability exp(-x)
    k = 1
    while _draw(x.denominator * k) < x.numerator:
        k += 1
    return k & 1


def geometric_exp(x: Fraction) -> int:
    """k with probability proportional to exp(-x k)."""
    if not x:
        raise ValueError("The rate has to be positive.")
    t = x.denominator
    while True:
        u = _draw(t)
        if bernoulli_exp(Fraction(u, t)):
            break
    v = 0
    while bernoulli_exp(Fraction(1)):
        v += 1
    return (v * t + u) // x.numerator


def discrete_laplace(scale: Fraction | float | int) -> int:
    """k with probability proportional to exp(-|k| / scale)."""
    rate = 1 / Fraction(scale)
    while True:
        negative, size = _draw(2), geometric_exp(rate)
        if size or not negative:
            return -size if negative else size


def discrete_gaussian(sigma_squared: Fraction | float | int) -> int:
    """k with probability proportional to exp(-k**2 / (2 sigma_squared))."""
    variance = Fraction(sigma_squared)
    if variance <= 0:
        return 0
    t = math.isqrt(variance.numerator // variance.denominator) + 1
    while True:
        y = discrete_laplace(Fraction(t))
        if bernoulli_exp((abs(y) - variance / t) ** 2 / (2 * variance)):
            return y


sample_dgauss = discrete_gaussian


def construct_inverse_sampler(inverse_cdf: Callable[[Interval], Interval], step_size: int = 63) -> Callable[[], float]:
    """A sampler from an inverse distribution function on intervals; always exact to the last bit of the float."""

    def sample() -> float:
        bits, n = 0, 0
        while True:
            bits, n = bits << step_size | secrets.randbits(step_size), n + step_size
            with precision(16 + n // 3):
                p = Interval(Fraction(bits, 1 << n), Fraction(bits + 1, 1 << n))
                try:
                    return inverse_cdf(p).to_float()
                except (ValueError, ZeroDivisionError, ArithmeticError):
                    continue

    return sample


def laplace_inverse_cdf(u: float, b: float, p: Interval) -> Interval:
    d = p - Interval(Decimal("0.5"))
    side = d.sign()
    if side is None:
        raise ValueError("The side of the median is not certain.")
    return Interval(Decimal(u)) - Interval(Decimal(b)) * side * (1 - 2 * abs(d)).ln()


def laplace(u: float, b: float, step_size: int = 63) -> float:
    """u plus Laplace noise of scale b."""
    return construct_inverse_sampler(lambda p: laplace_inverse_cdf(u, b, p), step_size)()


def gaussian_inverse_cdf(u, sigma_squared, p: Interval) -> Interval:
    return Interval(u if isinstance(u, (Interval, Fraction)) else Decimal(u)) + (Interval(sigma_squared if isinstance(sigma_squared, (Interval, Fraction)) else Decimal(sigma_squared)) * 2).sqrt() * erfinv(2 * p - 1)


def gaussian(sigma_squared, u=0, step_size: int = 63) -> float:
    """u plus Gaussian noise of variance sigma_squared."""
    return construct_inverse_sampler(lambda p: gaussian_inverse_cdf(u, sigma_squared, p), step_size)()


def uniform_inverse_cdf(lower: float, upper: float, p: Interval) -> Interval:
    return Interval(Decimal(lower)) * (1 - p) + Interval(Decimal(upper)) * p


def uniform(lower: float, upper: float, step_size: int = 63) -> float:
    """A uniform float in [lower, upper]."""
    if lower == upper:
        return float(lower)
    return construct_inverse_sampler(lambda p: uniform_inverse_cdf(lower, upper, p), step_size)()


def gumbel_inverse_cdf(p: Interval) -> Interval:
    return -((-(p.ln())).ln())
