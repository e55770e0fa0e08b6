"""Exact real numbers: sums of rationals times square roots, and infinities.

A number is ``sum(q_r * sqrt(r))`` over squarefree integers ``r``.  Square roots
of different squarefree integers are independent over the rationals, so a
number is zero exactly if it has no terms; signs come from decimal intervals
that are refined until they exclude zero.  That is all the arithmetic budgets,
stabilities and noise scales need.  Exponentials and logarithms are not exact
numbers; they are bounded by rationals (``exp_bounds``, ``ln_bounds``) and always
rounded to the side that weakens the guarantee.
"""

from __future__ import annotations

import ast
import math
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal
from fractions import Fraction
from functools import lru_cache, total_ordering
from numbers import Integral
from typing import Union

from quietframe.plans.errors import UnsupportedExpressionError

ExactNumberInput = Union["ExactNumber", int, Fraction, str, float]


@lru_cache(maxsize=4096)
def _squarefree(n: int) -> tuple[int, int]:
    """(s, r) with n = s**2 * r and no square of a small prime in r."""
    s, r, p = 1, n, 2
    while p * p <= r and p < 100_000:
        while r % (p * p) == 0:
            r //= p * p
            s *= p
        p += 1 if p == 2 else 2
    root = math.isqrt(r)
    return (s * root, 1) if root * root == r else (s, r)


def _sqrt_fraction(q: Fraction) -> dict[int, Fraction]:
    if q < 0:
        raise UnsupportedExpressionError(q, "Square roots of negative numbers are not real.")
    s, r = _squarefree(q.numerator * q.denominator)
    return {r: Fraction(s, q.denominator)} if q else {}


@total_ordering
class ExactNumber:
    """An exact real number or an infinity; finite floats are rejected, as they rarely are what they look like."""

    __slots__ = ("_terms", "_infinite")

    def __init__(self, value: ExactNumberInput = 0):
        self._infinite = 0
        if isinstance(value, ExactNumber):
            self._terms, self._infinite = value._terms, value._infinite
        elif isinstance(value, bool):
            raise TypeError("A truth value is not a number.")
        elif isinstance(value, (Integral, Fraction)):
            self._terms = {1: Fraction(int(value) if isinstance(value, Integral) else value)} if value else {}
        elif isinstance(value, str):
            parsed = _parse(value)
            self._terms, self._infinite = parsed._terms, parsed._infinite
        elif isinstance(value, float):
            if not math.isinf(value):
                raise ValueError(f"A finite float ({value}) is not an exact number; use a string, a Fraction or from_float.")
            self._terms, self._infinite = {}, 1 if value > 0 else -1
        else:
            raise TypeError(f"Not an exact number: {type(value).__name__}")

    @classmethod
    def _of(cls, terms: dict[int, Fraction], infinite: int = 0) -> ExactNumber:
        self = cls.__new__(cls)
        self._terms = {r: q for r, q in terms.items() if q}
        self._infinite = infinite
        return self

    @classmethod
    def sqrt(cls, value: ExactNumberInput) -> ExactNumber:
        x = cls(value)
        if x._infinite > 0:
            return x
        if set(x._terms) - {1} or x._infinite:
            raise UnsupportedExpressionError(str(x), "Only square roots of rational numbers are supported.")
        return cls._of(_sqrt_fraction(x.to_fraction()))

    # -- what it is

    @property
    def is_finite(self) -> bool:
        return not self._infinite

    @property
    def is_rational(self) -> bool:
        return not self._infinite and not set(self._terms) - {1}

    @property
    def is_integer(self) -> bool:
        return self.is_rational and self.to_fraction().denominator == 1

    @property
    def expr(self) -> str:
        return str(self)

    def to_fraction(self) -> Fraction:
        if not self.is_rational:
            raise ValueError(f"{self} is not rational.")
        return self._terms.get(1, Fraction(0))

    def bounds(self, digits: int = 40) -> tuple[Fraction, Fraction]:
        """Rationals below and above."""
        down, up = Context(prec=digits, rounding=ROUND_FLOOR), Context(prec=digits, rounding=ROUND_CEILING)
        low = high = Fraction(0)
        for r, q in self._terms.items():
            if r == 1:
                low, high = low + q, high + q
                continue
            a = Fraction(down.sqrt(Decimal(r))) * (1 - Fraction(1, 10 ** (digits - 1)))
            b = Fraction(up.sqrt(Decimal(r))) * (1 + Fraction(1, 10 ** (digits - 1)))
            low, high = low + q * (a if q > 0 else b), high + q * (b if q > 0 else a)
        return low, high

    def sign(self) -> int:
        if self._infinite:
            return self._infinite
        if not self._terms:
            return 0
        digits = 30
        while True:
            low, high = self.bounds(digits)
            if low > 0:
                return 1
            if high < 0:
                return -1
            digits *= 2

    # -- floats

    def to_float(self, round_up: bool) -> float:
        """The nearest float on the asked side, or an int for integers a float cannot hold better."""
        if self._infinite:
            return math.inf * self._infinite
        if self.is_integer:
            whole = int(self.to_fraction())
            if abs(whole) <= 2**53:
                return whole
        guess = self.bounds(40)[0]
        try:
            value = guess.numerator / guess.denominator
        except OverflowError:
            value = math.inf if guess > 0 else -math.inf
        toward = math.inf if round_up else -math.inf
        while not math.isinf(value) and (self > ExactNumber.from_float(value, round_up) if round_up else self < ExactNumber.from_float(value, round_up)):
            value = math.nextafter(value, toward)
        if math.isinf(value) and (value > 0) != round_up:
            value = math.nextafter(value, 0.0)
        return value

    @classmethod
    def from_float(cls, value: float, round_up: bool) -> ExactNumber:
        """The exact value of a float; ``round_up`` only says what the caller allows, since floats are exact."""
        if isinstance(value, Integral):
            return cls(int(value))
        if math.isnan(value):
            raise ValueError("NaN is not a number.")
        return cls(float(value)) if math.isinf(value) else cls(Fraction(float(value)))

    # -- arithmetic

    def __add__(self, other):
        other = ExactNumber(other)
        if self._infinite or other._infinite:
            if self._infinite * other._infinite < 0:
                raise ValueError("The sum of opposite infinities is undefined.")
            return ExactNumber._of({}, self._infinite or other._infinite)
        terms = dict(self._terms)
        for r, q in other._terms.items():
            terms[r] = terms.get(r, Fraction(0)) + q
        return ExactNumber._of(terms)

    __radd__ = __add__

    def __neg__(self):
        return ExactNumber._of({r: -q for r, q in self._terms.items()}, -self._infinite)

    def __sub__(self, other):
        return self + -ExactNumber(other)

    def __rsub__(self, other):
        return ExactNumber(other) + -self

    def __abs__(self):
        return -self if self.sign() < 0 else self

    def __mul__(self, other):
        other = ExactNumber(other)
        if self._infinite or other._infinite:
            sign = self.sign() * other.sign()
            if not sign:
                raise ValueError("The product of zero and an infinity is undefined.")
            return ExactNumber._of({}, sign)
        terms: dict[int, Fraction] = {}
        for r, q in self._terms.items():
            for t, p in other._terms.items():
                s, m = _squarefree(r * t)
                terms[m] = terms.get(m, Fraction(0)) + q * p * s
        return ExactNumber._of(terms)

    __rmul__ = __mul__

    def _inverse(self) -> ExactNumber:
        if not self._terms:
            raise ZeroDivisionError("Division by zero.")
        if self.is_rational:
            return ExactNumber(1 / self.to_fraction())
        if len(self._terms) == 1:
            ((r, q),) = self._terms.items()
            return ExactNumber._of({r: 1 / (q * r)})
        # a + b * sqrt(p): multiply by its conjugate, which frees the product of the factor p
        r = max(self._terms)
        p = next((f for f in range(2, 100_000) if r % f == 0), r)
        conjugate = ExactNumber._of({t: -q if t % p == 0 else q for t, q in self._terms.items()})
        return conjugate * (self * conjugate)._inverse()

    def __truediv__(self, other):
        other = ExactNumber(other)
        if other._infinite:
            if self._infinite:
                raise ValueError("The quotient of infinities is undefined.")
            return ExactNumber(0)
        if self._infinite:
            return ExactNumber._of({}, self._infinite * (other.sign() or 1))
        return self * other._inverse()

    def __rtruediv__(self, other):
        return ExactNumber(other) / self

    def __pow__(self, other):
        power = ExactNumber(other).to_fraction()
        if self._infinite:
            if not power:
                return ExactNumber(1)
            return ExactNumber(0) if power < 0 else ExactNumber._of({}, self._infinite if power.denominator == 1 and power.numerator % 2 else 1)
        if power.denominator == 2:
            return ExactNumber.sqrt(self) ** power.numerator
        if power.denominator != 1:
            raise UnsupportedExpressionError(f"({self})**({power})", "Only whole and half powers are supported.")
        out, base, n = ExactNumber(1), self if power >= 0 else self._inverse(), abs(power.numerator)
        while n:
            if n & 1:
                out = out * base
            base, n = base * base, n >> 1
        return out

    # -- comparison

    def __eq__(self, other):
        try:
            other = ExactNumber(other)
        except (TypeError, ValueError):
            return NotImplemented
        return self._infinite == other._infinite and self._terms == other._terms

    def __lt__(self, other):
        other = ExactNumber(other)
        if self._infinite or other._infinite:
            return self._infinite < other._infinite
        return (self - other).sign() < 0

    def __hash__(self):
        return hash((self._infinite, frozenset(self._terms.items())))

    def __bool__(self):
        return self.sign() != 0

    def __str__(self):
        if self._infinite:
            return "oo" if self._infinite > 0 else "-oo"
        parts = [str(q) if r == 1 else f"sqrt({r})" if q == 1 else f"{q}*sqrt({r})" for r, q in sorted(self._terms.items())]
        return " + ".join(parts) or "0"

    def __repr__(self):
        return f"ExactNumber({str(self)!r})" if self._infinite or not self.is_integer else f"ExactNumber({self})"


INFINITY = ExactNumber(math.inf)


def _parse(text: str) -> ExactNumber:
    """Numbers, ``+ - * / **``, parentheses, ``sqrt(...)`` and ``oo``."""
    fail = UnsupportedExpressionError(text, f"Not an exact number: {text!r}")
    source = text.strip()
    try:
        tree = ast.parse(source, mode="eval").body
    except SyntaxError:
        raise fail from None

    def value(node) -> ExactNumber:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return ExactNumber(Fraction(ast.get_source_segment(source, node).replace("_", "")))
        if isinstance(node, ast.Name) and node.id in ("oo", "inf"):
            return INFINITY
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            for kind, method in ((ast.Add, a.__add__), (ast.Sub, a.__sub__), (ast.Mult, a.__mul__), (ast.Div, a.__truediv__), (ast.Pow, a.__pow__)):
                if isinstance(node.op, kind):
                    return method(b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "sqrt" and len(node.args) == 1:
            return ExactNumber.sqrt(value(node.args[0]))
        raise fail

    try:
        return value(tree)
    except ZeroDivisionError:
        raise fail from None


def validate_exact_number(
    value: ExactNumberInput, allow_nonintegral: bool = True, minimum: ExactNumberInput | None = None, minimum_is_inclusive: bool = True,
    maximum: ExactNumberInput | None = None, maximum_is_inclusive: bool = True,
) -> None:
    """Raise ValueError unless the value is a number of the asked kind and range."""
    x = ExactNumber(value)
    if not allow_nonintegral and x.is_finite and not x.is_integer:
        raise ValueError(f"{x} is not an integer.")
    if minimum is not None and (x < minimum or (x == minimum and not minimum_is_inclusive)):
        raise ValueError(f"{x} is not {'at least' if minimum_is_inclusive else 'greater than'} {ExactNumber(minimum)}.")
    if maximum is not None and (x > maximum or (x == maximum and not maximum_is_inclusive)):
        raise ValueError(f"{x} is not {'at most' if maximum_is_inclusive else 'less than'} {ExactNumber(maximum)}.")


def _decimal_bounds(x: Fraction, digits: int, name: str) -> tuple[Fraction, Fraction]:
    context = Context(prec=digits)
    low = Context(prec=digits, rounding=ROUND_FLOOR).divide(Decimal(x.numerator), Decimal(x.denominator))
    high = Context(prec=digits, rounding=ROUND_CEILING).divide(Decimal(x.numerator), Decimal(x.denominator))
    a, b = getattr(context, name)(low), getattr(context, name)(high)
    slack = Fraction(10) ** (3 - digits)
    a, b = Fraction(a), Fraction(b)
    return a - abs(a) * slack - Fraction(10) ** (-2 * digits), b + abs(b) * slack + Fraction(10) ** (-2 * digits)


def exp_bounds(x: Fraction, digits: int = 60) -> tuple[Fraction, Fraction]:
    """Rationals around e**x."""
    return _decimal_bounds(x, digits, "exp")


def ln_bounds(x: Fraction, digits: int = 60) -> tuple[Fraction, Fraction]:
    """Rationals around the natural logarithm of x > 0."""
    return _decimal_bounds(x, digits, "ln")
