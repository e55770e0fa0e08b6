"""Decimal interval arithmetic: every operation encloses the true value."""

from __future__ import annotations

import math
from contextlib import contextmanager
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal, Overflow, Underflow, localcontext
from fractions import Fraction
from functools import lru_cache
from statistics import NormalDist

_digits = 50


@contextmanager
def precision(digits: int):
    """Work with so many digits inside the block."""
    global _digits
    before, _digits = _digits, digits
    try:
        yield
    finally:
        _digits = before


def _context(rounding: str) -> Context:
    return Context(prec=_digits, rounding=rounding, Emax=10**12, Emin=-(10**12), traps=[])


class Interval:
    """[low, high]; comparisons are true only if they hold for all values inside."""

    __slots__ = ("low", "high")

    def __init__(self, low, high=None):
        if isinstance(low, Interval):
            self.low, self.high = low.low, low.high
            return
        high = low if high is None else high
        self.low, self.high = self._end(low, ROUND_FLOOR), self._end(high, ROUND_CEILING)

    @staticmethod
    def _end(x, rounding: str) -> Decimal:
        if isinstance(x, Fraction):
            return _context(rounding).divide(Decimal(x.numerator), Decimal(x.denominator))
        return _context(rounding).plus(x if isinstance(x, Decimal) else Decimal(x))

    @classmethod
    def _make(cls, low: Decimal, high: Decimal) -> Interval:
        self = cls.__new__(cls)
        self.low, self.high = low, high
        return self

    def _two(self, other, name: str) -> Interval:
        other = Interval(other)
        down, up = _context(ROUND_FLOOR), _context(ROUND_CEILING)
        ends = [(a, b) for a in (self.low, self.high) for b in (other.low, other.high)]
        return Interval._make(min(getattr(down, name)(a, b) for a, b in ends), max(getattr(up, name)(a, b) for a, b in ends))

    def __add__(self, other):
        other = Interval(other)
        return Interval._make(_context(ROUND_FLOOR).add(self.low, other.low), _context(ROUND_CEILING).add(self.high, other.high))

    __radd__ = __add__

    def __neg__(self):
        return Interval._make(self.high.copy_negate(), self.low.copy_negate())

    def __sub__(self, other):
        return self + -Interval(other)

    def __rsub__(self, other):
        return Interval(other) + -self

    def __mul__(self, other):
        return self._two(other, "multiply")

    __rmul__ = __mul__

    def __truediv__(self, other):
        other = Interval(other)
        if other.low <= 0 <= other.high:
            raise ZeroDivisionError("The divisor may be zero.")
        return self._two(other, "divide")

    def __rtruediv__(self, other):
        return Interval(other) / self

    def _rounded(self, name: str) -> Interval:
        """A function of the decimal module, whose results are right to a unit in the last place."""
        down, up = _context(ROUND_FLOOR), _context(ROUND_CEILING)
        return Interval._make(down.next_minus(getattr(down, name)(self.low)), up.next_plus(getattr(up, name)(self.high)))

    def exp(self):
        return self._rounded("exp")

    def ln(self):
        if self.low <= 0:
            raise ValueError("The argument of a logarithm may not be positive.")
        return self._rounded("ln")

    def sqrt(self):
        low = max(self.low, Decimal(0))
        down, up = _context(ROUND_FLOOR), _context(ROUND_CEILING)
        return Interval._make(max(Decimal(0), down.next_minus(down.sqrt(low))), up.next_plus(up.sqrt(self.high)))

    def power(self, exponent):
        """self ** exponent for positive values."""
        return (self.ln() * exponent).exp()

    def square(self):
        both = self * self
        return Interval._make(max(both.low, Decimal(0)), both.high)

    def __abs__(self):
        if self.low >= 0:
            return self
        return -self if self.high <= 0 else Interval._make(Decimal(0), max(self.low.copy_negate(), self.high))

    def sign(self) -> int | None:
        """1, 0 or -1, or None if it is not certain."""
        if self.low > 0:
            return 1
        if self.high < 0:
            return -1
        return 0 if self.low == self.high == 0 else None

    def union(self, other):
        other = Interval(other)
        return Interval._make(min(self.low, other.low), max(self.high, other.high))

    def max(self, other):
        other = Interval(other)
        return Interval._make(max(self.low, other.low), max(self.high, other.high))

    def min(self, other):
        other = Interval(other)
        return Interval._make(min(self.low, other.low), min(self.high, other.high))

    def __lt__(self, other):
        return self.high < Interval(other).low

    def __gt__(self, other):
        return self.low > Interval(other).high

    def to_float(self) -> float:
        """The float that all values inside round to; ValueError if there are several."""
        low, high = float(self.low), float(self.high)
        if low != high:
            raise ValueError("The interval does not round to one float.")
        return high + 0.0

    def middle(self) -> Decimal:
        return _context(ROUND_FLOOR).divide(_context(ROUND_FLOOR).add(self.low, self.high), Decimal(2))

    def __repr__(self):
        return f"[{self.low}, {self.high}]"


def pi() -> Interval:
    """By Machin's formula."""

    def arctan_inverse(n: int) -> Interval:
        total, term, k = Interval(0), Interval(1) / n, 0
        bound = Decimal(10) ** -(_digits + 2)
        while abs(term).high > bound:
            part = term / (2 * k + 1)
            total = total - part if k % 2 else total + part
            term, k = term / (n * n), k + 1
        rest = abs(term).high
        return Interval._make(_context(ROUND_FLOOR).subtract(total.low, rest), _context(ROUND_CEILING).add(total.high, rest))

    return 4 * (4 * arctan_inverse(5) - arctan_inverse(239))


def _around(value: Decimal, error: Decimal) -> Interval:
    return Interval._make(_context(ROUND_FLOOR).subtract(value, error), _context(ROUND_CEILING).add(value, error))


@lru_cache(maxsize=64)
def _two_over_root_pi(digits: int) -> Decimal:
    with precision(digits):
        return (2 / pi().sqrt()).middle()


def _erf_near(x: Decimal) -> Decimal:
    """erf(x) for x >= 0 with an error below 10**-digits: the alternating series with digits to spare for cancellation."""
    square = float(x) ** 2
    digits = _digits + 12 + int(0.9 * square)
    with localcontext(Context(prec=digits, Emax=10**12, Emin=-(10**12), traps=[])):
        y, term, total, k, small = x * x, x, Decimal(0), 0, Decimal(10) ** -(_digits + 8)
        while True:
            part = term / (2 * k + 1)
            total = total - part if k % 2 else total + part
            if k > square and part < small:
                return total * _two_over_root_pi(digits)
            k += 1
            term = term * y / k


def erf(x: Interval) -> Interval:
    """The error function; far out, by the bound of its tail."""
    x = Interval(x)

    def at(v: Decimal) -> Interval:
        if v < 0:
            return -at(v.copy_negate())
        if float(v) ** 2 > 2.31 * (_digits + 5):  # 1 - erf(v) <= exp(-v*v)
            return Interval._make((1 - (-(Interval(v).square())).exp()).low, Decimal(1))
        near = _around(_erf_near(v), Decimal(10) ** -_digits)
        return near.min(1)

    return at(x.low).union(at(x.high))


def erfinv(p: Interval) -> Interval:
    """The inverse error function: Newton steps, then ends that ``erf`` proves."""
    p = Interval(p)
    if p.low <= -1 or p.high >= 1:
        raise ValueError("The inverse error function is finite inside (-1, 1) only.")
    return _erfinv_end(p.low, False).union(_erfinv_end(p.high, True))


def _erfinv_end(p: Decimal, above: bool) -> Interval:
    if p == 0:
        return Interval(0)
    if p < 0:
        return -_erfinv_end(p.copy_negate(), not above)
    with localcontext(Context(prec=_digits + 15, Emax=10**12, Emin=-(10**12), traps=[])):
        q = float(p)
        start = NormalDist().inv_cdf((1 + q) / 2) / math.sqrt(2) if q < 1 - 1e-9 else math.sqrt(-float((1 - p).ln()))
        x, half = Decimal(start), 1 / _two_over_root_pi(_digits + 15)
        for _ in range(60):
            step = (_erf_near(x) - p) * half * (x * x).exp()
            x -= max(Decimal(-1), min(Decimal(1), step))
            if abs(step) <= Decimal(10) ** -(_digits // 2 + 2):
                break  # steps square: the next error is far below the last digit
        width = (x * x).exp() * Decimal(10) ** (3 - _digits)
        for _ in range(40):
            end = x + width if above else x - width
            proof = erf(Interval(end))
            if proof.low >= p if above else proof.high <= p:
                return Interval(end)
            width *= 8
    raise ArithmeticError("No end can be proved at this precision.")


def lambert_w(x: Interval) -> Interval:
    """The principal branch for x >= 0: Newton steps, then ends that w * exp(w) proves."""
    x = Interval(x)

    def end(v: Decimal, above: bool) -> Interval:
        if v == 0:
            return Interval(0)
        with localcontext(Context(prec=_digits + 15, Emax=10**12, Emin=-(10**12), traps=[])):
            w = (v + 1).ln()
            for _ in range(200):
                e = w.exp()
                step = (w * e - v) / (e * (w + 1))
                w -= step
                if abs(step) <= abs(w) * Decimal(10) ** -(_digits // 2 + 2):
                    break
            width = abs(w) * Decimal(10) ** (3 - _digits)
            for _ in range(40):
                edge = Interval(w + width if above else w - width)
                proof = edge * edge.exp()
                if proof.low >= v if above else proof.high <= v:
                    return edge
                width *= 8
        raise ArithmeticError("No end can be proved at this precision.")

    return end(x.low, False).union(end(x.high, True))


__all__ = ["Interval", "Overflow", "Underflow", "erf", "erfinv", "lambert_w", "pi", "precision"]
