"""Numbers as pairs of extended floats, about twice as precise, over whole arrays.

Sums and products are those of Dekker, "A Floating-Point Technique for Extending
the Available Precision" (1971).  A step is right to a few units of 2**-124 of its
size; what is returned is claimed to be right to ``ERROR`` only.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np

LD = np.longdouble
#: Relative error that is claimed for a few steps, of which an exponential number is one.
ERROR = LD(2) ** -90
#: Below this size products leave the range in which their errors are floats.
SMALL = LD(2) ** -900
_SPLIT = LD(2) ** ((np.finfo(LD).nmant + 2) // 2) + 1

Pair = tuple[np.ndarray, np.ndarray]


def of(x: Fraction | Decimal) -> Pair:
    """A number as a pair."""

    def nearest(v: Fraction) -> np.longdouble:
        shift = 62 - (abs(v.numerator).bit_length() - v.denominator.bit_length())
        whole = round(v * Fraction(2) ** shift) if v else 0
        high, low = divmod(whole, 1 << 31)
        return np.ldexp(np.ldexp(LD(high), 31) + LD(low), -shift)

    def exact(v: np.longdouble) -> Fraction:
        return Fraction(*v.as_integer_ratio())

    x = Fraction(x)
    high = nearest(x)
    return high, nearest(x - exact(high))


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    c = _SPLIT * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    p = a * b
    (a1, a2), (b1, b2) = _halves(a), _halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def negative(a: Pair) -> Pair:
    return -a[0], -a[1]


_LN2 = of(Decimal("0.69314718055994530941723212145817656807550013436025525412068000949339362196969471560586332699641868754200148102057068573368552"))
#: exp(x) is taken near multiples of ln 2 / STEPS, whose exponential numbers are held.
_STEPS, _TERMS = 256, 9
with localcontext() as _context:
    _context.prec = 60
    _POWERS = [of(Decimal(2) ** (Decimal(j) / _STEPS)) for j in range(_STEPS)]
_POWERS = np.array([p[0] for p in _POWERS]), np.array([p[1] for p in _POWERS])
_STEP = _LN2[0] / _STEPS, _LN2[1] / _STEPS
_INVERSE = [LD(1) / LD(math.factorial(n)) for n in range(_TERMS + 1)]


def exp(x: Pair) -> Pair:
    """exp(x) for |x| below 10,000: a power that is held, times the exponential number of what is left, by its series.

    What is left is below 2**-9, so that its third power times the error of an
    extended float is below 2**-90 of the result, and pairs are needed for its
    square only.
    """
    k = np.rint(x[0] / _STEP[0])
    r = add(x, multiply((-k, k * 0), _STEP))
    rest = _INVERSE[-1]
    for c in _INVERSE[-2:2:-1]:
        rest = rest * r[0] + c
    square = multiply(r, r)
    total = add(r, add((square[0] / 2, square[1] / 2), (rest * r[0] * square[0], k * 0)))  # exp(r) - 1
    k = k.astype(np.int64)
    place = k % _STEPS
    power = _POWERS[0][place], _POWERS[1][place]
    total = add(power, multiply(power, total))
    return np.ldexp(total[0], k // _STEPS), np.ldexp(total[1], k // _STEPS)


def log(x: Pair) -> Pair:
    """ln(x) for x above 0: the logarithm in extended precision, and that of what it leaves; right to ``ERROR`` of 1 and of its size, whichever is larger."""
    y = np.log(x[0])
    left = add(multiply(x, exp((-y, y * 0))), (y * 0 - 1, y * 0))  # of the size of y's error
    r = left[0] + left[1]
    return add((y, y * 0), add(left, (-r * r / 2, r * 0)))


def rounded(x: Pair, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The floats to which all numbers within the error of x round, and where it is certain that they are."""
    out = x[0].astype(np.float64)
    for _ in range(2):
        off = (x[0] - out.astype(LD)) + x[1]
        up = (np.nextafter(out, np.inf).astype(LD) - out.astype(LD)) / 2
        down = (out.astype(LD) - np.nextafter(out, -np.inf).astype(LD)) / 2
        out = np.where(off > up, np.nextafter(out, np.inf), np.where(off < -down, np.nextafter(out, -np.inf), out))
    off = (x[0] - out.astype(LD)) + x[1]
    slack = error + np.abs(off) * LD(2) ** -60
    up = (np.nextafter(out, np.inf).astype(LD) - out.astype(LD)) / 2
    down = (out.astype(LD) - np.nextafter(out, -np.inf).astype(LD)) / 2
    return out, np.isfinite(out) & (np.abs(out) > 1e-250) & (off + slack < up) & (off - slack > -down)
