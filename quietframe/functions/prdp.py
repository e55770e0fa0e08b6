"""Mechanisms whose loss depends on the record: noise on a transformed value."""

from __future__ import annotations

import math
from decimal import Context, Decimal, localcontext

from quietframe.functions.interval import Interval, erf, erfinv, lambert_w
from quietframe.functions.samplers import construct_inverse_sampler, gaussian


def _floor(x: float, offset: float) -> float:
    if x + offset < 0:
        raise ValueError("The value plus the offset has to be at least zero.")
    return x + offset


def fourth_root_transformation_mechanism(x: float, offset: float, sigma: float) -> float:
    """(fourth root of (x + offset) plus Gaussian noise) to the fourth, less the offset."""
    return (_floor(x, offset) ** 0.25 + gaussian(sigma**2)) ** 4 - offset


def square_root_transformation_mechanism(x: float, offset: float, sigma: float) -> float:
    """(square root of (x + offset) plus Gaussian noise) squared, less the offset."""
    return (math.sqrt(_floor(x, offset)) + gaussian(sigma**2)) ** 2 - offset


def log_transformation_mechanism(x: float, offset: float, sigma: float) -> float:
    """exp(ln(x + offset) plus Gaussian noise), less the offset."""
    if x + offset <= 0:
        raise ValueError("The value plus the offset has to be positive.")
    return math.exp(math.log(x + offset) + gaussian(sigma**2)) - offset


def phi(x: Interval) -> Interval:
    """The normal distribution function."""
    return (erf(Interval(x) / Interval(2).sqrt()) + 1) / 2


def phi_inverse(p: Interval) -> Interval:
    return Interval(2).sqrt() * erfinv(2 * Interval(p) - 1)


def square_root_gaussian_inverse_cdf(p: Interval, sigma: float) -> Interval:
    """Inverse distribution function of the density proportional to exp(-sqrt(|x| / sigma)).

    With t = sqrt(|x| / sigma) the tail beyond |x| is (1 + t) exp(-t) / 2, which the
    lower branch of Lambert's function inverts; here by bisection on intervals.
    """
    d = p - Interval(Decimal("0.5"))
    side = d.sign()
    if side is None:
        raise ValueError("The side of the median is not certain.")
    tail = 1 - 2 * abs(d)

    def at(value: Decimal) -> Interval:
        target = Interval(value)
        beyond = lambda t: (1 + Interval(t)) * (-Interval(t)).exp()
        with localcontext(Context(prec=200, traps=[])):
            low, high = Decimal(0), Decimal(2)
            while not (beyond(high) < target):
                high *= 2
            for _ in range(200):
                middle = (low + high) / 2
                side_of_middle = beyond(middle) > target, beyond(middle) < target
                if not any(side_of_middle):
                    break
                low, high = (middle, high) if side_of_middle[0] else (low, middle)
            return Interval(low, high)

    t = at(tail.low).union(at(tail.high))
    return Interval(side) * t.square() * Decimal(sigma)


def square_root_gaussian_mechanism(sigma: float) -> float:
    """A draw of that noise."""
    return construct_inverse_sampler(lambda p: square_root_gaussian_inverse_cdf(p, sigma))()


def exponential_polylogarithmic_inverse_cdf(p: Interval, d: float, a: float, sigma: float) -> Interval:
    """Inverse distribution function of the density proportional to exp(-d * ln(|x| / sigma + a)**2).

    y = ln(|x| / sigma + a) has the density of a normal variable of mean and
    variance 1 / (2 d), cut below ln(a), so its inverse is the normal one on what
    is left.
    """
    off = p - Interval(Decimal("0.5"))
    side = off.sign()
    if side is None:
        raise ValueError("The side of the median is not certain.")
    variance, shift = 1 / (2 * Interval(Decimal(d))), Interval(Decimal(a))
    deviation = variance.sqrt()
    below = phi((shift.ln() - variance) / deviation)
    y = phi_inverse(below + (1 - below) * (2 * abs(off))) * deviation + variance
    return Interval(side) * (y.exp() - shift) * Decimal(sigma)


def exponential_polylogarithmic_mechanism(d: float, a: float, sigma: float, step_size: int = 63) -> float:
    """A draw of that noise."""
    return construct_inverse_sampler(lambda p: exponential_polylogarithmic_inverse_cdf(p, d, a, sigma), step_size)()


__all__ = ["exponential_polylogarithmic_mechanism", "fourth_root_transformation_mechanism", "lambert_w", "log_transformation_mechanism", "square_root_gaussian_mechanism", "square_root_transformation_mechanism"]
