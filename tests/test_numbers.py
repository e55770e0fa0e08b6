"""Exact numbers, intervals, samplers and distributions."""

import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietframe.functions import distributions as d
from quietframe.functions import interval as iv
from quietframe.functions import prdp, samplers
from quietframe.functions.exact import INFINITY, ExactNumber, exp_bounds, ln_bounds, validate_exact_number

X = ExactNumber
FRACTIONS = st.fractions(min_value=-50, max_value=50, max_denominator=40)
SURDS = st.tuples(FRACTIONS, FRACTIONS, st.integers(0, 30)).map(lambda t: X(t[0]) + X(t[1]) * X.sqrt(t[2]))


@settings(max_examples=150, deadline=None)
@given(SURDS, SURDS, SURDS)
def test_field(a, b, c):
    assert a + b == b + a and (a + b) + c == a + (b + c)
    assert a * (b + c) == a * b + a * c
    assert a - a == 0 and (not b or (a / b) * b == a)
    value = lambda x: float(x.bounds()[0])
    assert math.isclose(value(a * b), value(a) * value(b), rel_tol=1e-9, abs_tol=1e-9)
    assert (a < b) == (value(a) < value(b)) or abs(value(a) - value(b)) < 1e-9


@settings(max_examples=150, deadline=None)
@given(SURDS)
def test_directed_floats(a):
    low, high = a.to_float(False), a.to_float(True)
    assert X.from_float(low, False) <= a <= X.from_float(high, True)


@pytest.mark.parametrize("text,value", [("0.1", X(Fraction(1, 10))), ("sqrt(8)", 2 * X.sqrt(2)), ("sqrt(5/3)", X.sqrt(Fraction(5, 3))), ("2**3 - 1/2", X(Fraction(15, 2))), ("oo", INFINITY), ("-oo", -INFINITY), ("4**(1/2)", X(2)), ("1e3", X(1000))])
def test_texts(text, value):
    assert X(text) == value


@pytest.mark.parametrize("bad", [0.5, True, None, "x", "1/0", "sqrt(-1)", "", float("nan"), "pi", "__import__('os')"])
def test_not_exact(bad):
    with pytest.raises((ValueError, TypeError)):
        X(bad)


def test_infinities():
    assert X(float("inf")) == INFINITY and INFINITY > 10**400 and 1 / INFINITY == 0 and INFINITY.to_float(True) == math.inf
    for undefined in (lambda: INFINITY - INFINITY, lambda: INFINITY * 0, lambda: INFINITY / INFINITY):
        with pytest.raises(ValueError):
            undefined()
    with pytest.raises(ZeroDivisionError):
        X(1) / 0
    with pytest.raises(ValueError):
        validate_exact_number("1/2", allow_nonintegral=False)
    with pytest.raises(ValueError):
        validate_exact_number(0, minimum=0, minimum_is_inclusive=False)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 5), st.floats(-3, 3))
def test_intervals_enclose(x, y):
    box = iv.Interval(Fraction(x), Fraction(x))
    for got, want in ((box.exp(), math.exp(x)), (box.ln(), math.log(x)), (box.sqrt(), math.sqrt(x)), (box * iv.Interval(Fraction(y)), x * y), (iv.erf(iv.Interval(Fraction(y))), math.erf(y))):
        assert got.low <= got.high and math.isclose(float(got.low), want, rel_tol=1e-9, abs_tol=1e-12)
    back = iv.erf(iv.erfinv(iv.Interval(Fraction(y) / 4)))
    assert back.low <= Fraction(y) / 4 <= back.high
    w = iv.lambert_w(box)
    again = w * w.exp()
    assert again.low <= Fraction(x) <= again.high


def test_bounds_of_exp_and_ln():
    for q in (Fraction(0), Fraction(-7, 3), Fraction(20)):
        low, high = exp_bounds(q)
        assert low <= high and math.isclose(low, math.exp(q), rel_tol=1e-12)
    assert ln_bounds(Fraction(10))[0] < ln_bounds(Fraction(10))[1]


N = 4000


def chi_squared(draws, pmf, lows, highs):
    """Largest standardised distance of counts from what the masses say."""
    draws = np.asarray(draws)
    worst = 0.0
    for k in range(lows, highs + 1):
        p = float(pmf(k))
        worst = max(worst, abs((draws == k).sum() - len(draws) * p) / math.sqrt(len(draws) * p * (1 - p)))
    return worst


@pytest.mark.parametrize("scale", [1, Fraction(5, 2)])
def test_discrete_laplace(scale):
    assert chi_squared([samplers.discrete_laplace(scale) for _ in range(N)], lambda k: d.double_sided_geometric_pmf(k, float(scale)), -5, 5) < 6


@pytest.mark.parametrize("variance", [1, Fraction(25, 4)])
def test_discrete_gaussian(variance):
    assert chi_squared([samplers.discrete_gaussian(variance) for _ in range(N)], lambda k: d.discrete_gaussian_pmf(k, float(variance)), -3, 3) < 6


def ks(draws, cdf):
    x = np.sort(draws)
    return np.abs(np.arange(1, len(x) + 1) / len(x) - np.array([cdf(v) for v in x])).max() * math.sqrt(len(x))


def test_continuous():
    assert ks([samplers.laplace(1.0, 2.0) for _ in range(1500)], lambda v: 0.5 * math.exp((v - 1) / 2) if v < 1 else 1 - 0.5 * math.exp(-(v - 1) / 2)) < 2.6
    assert ks([samplers.gaussian(4.0, 1) for _ in range(1000)], lambda v: 0.5 * (1 + math.erf((v - 1) / math.sqrt(8)))) < 2.6
    assert ks([samplers.uniform(-1.0, 3.0) for _ in range(1000)], lambda v: (v + 1) / 4) < 2.6
    root = lambda v: math.sqrt(abs(v) / 3)
    assert ks([prdp.square_root_gaussian_mechanism(3.0) for _ in range(200)], lambda v: 0.5 + math.copysign(0.5 * (1 - (1 + root(v)) * math.exp(-root(v))), v)) < 2.6
    grid = np.exp(np.linspace(math.log(1.5), 12, 40001)) - 1.5
    mass = np.concatenate([[0], np.cumsum(np.exp(-2 * np.log((grid[1:] + grid[:-1]) / 2 + 1.5) ** 2) * np.diff(grid))])
    assert ks([prdp.exponential_polylogarithmic_mechanism(2.0, 1.5, 3.0) for _ in range(400)], lambda v: 0.5 + math.copysign(0.5 * np.interp(abs(v) / 3, grid, mass / mass[-1]), v)) < 2.6
    assert samplers.uniform(2.0, 2.0) == 2.0
    for f in (prdp.fourth_root_transformation_mechanism, prdp.square_root_transformation_mechanism, prdp.log_transformation_mechanism):
        assert abs(f(100.0, 1.0, 1e-6) - 100) < 0.1


def test_distribution_functions():
    k = np.arange(-30, 31)
    for a in (0.7, 3.0):
        assert np.allclose(np.cumsum(d.double_sided_geometric_pmf(np.arange(-200, 31), a))[-61:], d.double_sided_geometric_cmf(k, a))
        for p in (0.01, 0.3, 0.5, 0.9, 0.999):
            q = int(d.double_sided_geometric_inverse_cmf(p, a))
            assert d.double_sided_geometric_cmf(q, a) >= p > d.double_sided_geometric_cmf(q - 1, a)
            exact = d.double_sided_geometric_inverse_cmf_exact(str(p), str(a))
            assert int(exact.to_fraction()) == q
    assert np.allclose(np.cumsum(d.discrete_gaussian_pmf(np.arange(-80, 31), 9.0))[-61:], d.discrete_gaussian_cmf(k, 9.0))
    assert d.discrete_gaussian_inverse_cmf(0.5, 9.0) == 0
    assert d.double_sided_geometric_cmf_exact(3, 2) <= X.from_float(d.double_sided_geometric_cmf(3, 2.0) + 1e-12, True)


def test_random_order_does_not_matter():
    rng = random.Random(1)
    parts = [X(rng.randrange(9)) * X.sqrt(rng.randrange(20)) for _ in range(20)]
    total = sum(parts, X(0))
    rng.shuffle(parts)
    assert sum(parts, X(0)) == total and hash(sum(parts, X(0))) == hash(total)


def test_helpers():
    from quietframe.functions import helpers

    inner = {"a": [1, [2]]}
    copied = helpers.copy_if_mutable(inner)
    copied["a"][1].append(3)
    assert inner == {"a": [1, [2]]}
    assert helpers.get_element_type([1, None, 2]) is int and helpers.get_fullname(X(1)) == "quietframe.functions.exact.ExactNumber"
    with pytest.raises(ValueError):
        helpers.get_element_type([1, "a"])
    draws = [samplers.RNGWrapper().randrange(5) for _ in range(2000)]
    assert set(draws) == set(range(5)) and max(abs(draws.count(k) - 400) for k in range(5)) < 120


def test_batches_follow_their_laws():
    from quietframe.functions import batches

    n = 60_000
    for scale in (Fraction(1, 3), Fraction(3), Fraction(1000, 7)):
        x, g = batches.discrete_laplace(scale, n), math.exp(-1 / float(scale))
        for k in (-2, -1, 0, 1, 2):
            p = (1 - g) / (1 + g) * g ** abs(k)
            assert abs((x == k).mean() - p) < 6 * math.sqrt(p * (1 - p) / n) + 1e-4
    for variance in (Fraction(1, 2), Fraction(9)):
        x, k = batches.discrete_gaussian(variance, n), np.arange(-60, 61)
        p = np.exp(-k * k / (2 * float(variance)))
        p /= p.sum()
        for j in (-2, -1, 0, 1, 2):
            q = p[60 + j]
            assert abs((x == j).mean() - q) < 6 * math.sqrt(q * (1 - q) / n) + 1e-4
    for x, cdf in ((batches.laplace(np.full(n, 1.5), 2.0), lambda v: 0.5 * math.exp((v - 1.5) / 2) if v < 1.5 else 1 - 0.5 * math.exp(-(v - 1.5) / 2)), (batches.gaussian(np.full(n, 1.5), Fraction(4)), statistics.NormalDist(1.5, 2).cdf)):
        for v in (-4.0, -1.0, 1.5, 2.0, 5.0):
            p = cdf(v)
            assert abs((x <= v).mean() - p) < 6 * math.sqrt(p * (1 - p) / n)


def test_batches_round_as_the_exact_samplers_do(monkeypatch):
    """With the same bits, the floats are those of exact arithmetic."""
    from quietframe.functions import batches
    from quietframe.functions.interval import Interval, precision

    bits = np.array([1, 5 << 40, (1 << 62) - 3, (1 << 62) + 9, (1 << 63) - 2, *[random.Random(7).randrange(1 << 63) for _ in range(200)]], np.uint64)
    monkeypatch.setattr(batches, "random_bits", lambda n: bits)
    got = batches.laplace(np.full(len(bits), 0.1), 3.0)
    sure = 0
    for b, v in zip(bits.tolist(), got):
        with precision(60):
            try:
                want = samplers.laplace_inverse_cdf(0.1, 3.0, Interval(Fraction(b, 1 << 63), Fraction(b + 1, 1 << 63))).to_float()
            except (ValueError, ArithmeticError):
                continue
        sure += 1
        assert v == want
    assert sure > 150


def test_undecided_draws_go_on_with_more_bits(monkeypatch):
    from quietframe.functions import batches

    monkeypatch.setattr(batches, "SLACK", batches.LD(1) / 3)
    monkeypatch.setattr(batches, "FINE", batches.LD(1) / 3)
    n, g = 1500, math.exp(-1 / 3)
    for x, variance in ((batches.discrete_laplace(Fraction(3), n), 2 * g / (1 - g) ** 2), (batches.discrete_gaussian(Fraction(9), n), 9), (batches.laplace(np.zeros(n), 3.0), 18), (batches.gaussian(np.zeros(60), Fraction(9)), 9)):
        assert abs(x.mean()) < 6 * math.sqrt(variance / len(x)) and 0.4 < x.var() / variance < 2.5
