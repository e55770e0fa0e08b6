"""Quantiles of groups by the exponential mechanism, over ranges of values.

Values of a group are counted, sorted and dealt out in ranges (``ranges``), so
that no task holds more than its share of a group however large it is.  An
interval between neighbouring values is weighed by its length and by how far its
rank is from the one asked for; the largest weight with Gumbel noise wins, which
is the exponential mechanism.

Who wins is decided by bounds.  Noise is a uniform number of which some bits are
known; floats with bounds of their errors leave a few contenders, nearly always
one, and only these get more bits and exact bounds.  Contenders with the bits
that they have are a state that can be merged: a group that is cut gives some from
each of its pieces, and they are settled together.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quietframe.functions.batches import random_bits
from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.functions.interval import Interval, precision
from quietframe.functions.samplers import gumbel_inverse_cdf, uniform
from quietframe.operators.grouped import named
from quietframe.operators.ranges import Piece, SortedGroups, key_columns, within
from quietframe.sources.shared import get_materialized_df

BITS = 63


class LogWeights:
    """Logarithms of intervals' weights, their lengths times exp(-rate away): floats with bounds of their errors, and bounds as narrow as asked."""

    def __init__(self, low: np.ndarray, high: np.ndarray, away: Sequence[Fraction], rate: ExactNumber):
        self._low, self._high, self._away, self._rate = low, high, away, rate
        self.floats, self.errors = float_weights(low, high, np.array([float(a) for a in away]), np.zeros(len(away)), rate)

    def __len__(self) -> int:
        return len(self._away)

    def bounds(self, i: int, digits: int) -> Interval:
        least, most = self._rate.bounds(4 * digits)
        length = Fraction(float(self._high[i])) - Fraction(float(self._low[i]))
        return Interval(length).ln() - Interval(least * self._away[i], most * self._away[i])


def float_weights(low: np.ndarray, high: np.ndarray, away: np.ndarray, doubt: np.ndarray, rate: ExactNumber) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of weights and bounds of their errors; ``doubt`` bounds the errors of ``away``."""
    length, factor = np.log(high - low), rate.to_float(True)
    loss = factor * away
    return length - loss, 1e-9 + 1e-12 * (np.abs(length) + np.abs(loss)) + factor * doubt * (1 + 1e-9)


def first_bounds(floats: np.ndarray, errors: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of noisy weights from the first ``BITS`` bits of each uniform number."""
    u = bits.astype(np.float64) / 2.0**BITS
    with np.errstate(divide="ignore", invalid="ignore"):
        below, above = (-np.log(-np.log(np.clip(u + d, 0.0, 1.0))) for d in (-(2.0**-52), 2.0**-52))
    below, above = np.where(np.isnan(below), -np.inf, below), np.where(np.isnan(above), np.inf, above)
    slack = errors + 1e-9 + 1e-9 * np.abs(np.where(np.isfinite(below), below, 0))
    return floats + below - slack, np.where(u >= 1 - 1e-9, np.inf, floats + above + slack)


def settled(weights: LogWeights, bits: list[int], size: list[int]) -> int:
    """The number whose noisy weight is the largest, by more bits and exact bounds for as long as it is open."""
    left, digits = list(range(len(bits))), 24
    while len(left) > 1:
        ends = {}
        with precision(digits):
            for i in left:
                p = Interval(Fraction(bits[i], 1 << size[i]), Fraction(bits[i] + 1, 1 << size[i]))
                try:
                    score = weights.bounds(i, digits) + gumbel_inverse_cdf(p)
                    ends[i] = score.low, score.high
                except (ValueError, ZeroDivisionError, ArithmeticError):
                    ends[i] = None
        known = [e[0] for e in ends.values() if e is not None]
        left = [i for i in left if ends[i] is None or not known or ends[i][1] >= max(known)]
        for i in left:
            bits[i], size[i] = bits[i] << 15 | secrets.randbits(15), size[i] + 15
        digits += 6
    return left[0]


def largest_gumbel(weights: LogWeights) -> int:
    """The number i that maximises weight i plus Gumbel noise, decided by bounds."""
    bits = random_bits(len(weights))
    low, high = first_bounds(weights.floats, weights.errors, bits)
    left = np.flatnonzero(high >= low.max())
    few = LogWeights(weights._low[left], weights._high[left], [weights._away[i] for i in left.tolist()], weights._rate)
    return int(left[settled(few, [int(b) for b in bits[left]], [BITS] * len(left))])


def rate_of(quantile: float, epsilon: ExactNumber) -> ExactNumber:
    """What a rank that is one off costs in the logarithm of a weight."""
    q = ExactNumber(Fraction(quantile))
    return epsilon / (2 * max(q, 1 - q))


def winner(low: np.ndarray, high: np.ndarray, rank: Sequence[int], total: int, bits: Sequence[int], quantile: float, epsilon: ExactNumber) -> int:
    """Which of the contenders of a group it is; without noise the one of the nearest rank, the lower of two."""
    target = Fraction(quantile) * total
    away = [abs(int(r) - target) for r in rank]
    if len(away) == 1:
        return 0
    if epsilon == INFINITY:
        return min(range(len(away)), key=lambda i: (away[i], rank[i]))
    return settled(LogWeights(np.asarray(low, float), np.asarray(high, float), away, rate_of(quantile, epsilon)), [int(b) for b in bits], [BITS] * len(away))


def _summary(table: pa.Table) -> list[str]:
    """Of a group's rows: whether its key is asked for, how many rows the values stand for, the last value."""
    n = table.column("__n").to_numpy()
    value = table.column("__value")
    last = value[len(value) - 1].as_py() if n.sum() else None
    return [str(int((n == 0).any())), str(int(n.sum())), "" if last is None else float(last).hex()]


def _intervals(table: pa.Table, starts: np.ndarray, pieces: dict[int, Piece], lower: float, upper: float):
    """All intervals of a partition's groups that have length: group, ends, rank; and each group's total and whether its key is asked for."""
    n = table.column("__n").to_numpy()
    value = table.column("__value").to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(np.append(starts, len(n)))
    group = np.repeat(np.arange(len(starts)), sizes)
    running = within(starts, n)
    total = running[np.append(starts[1:], len(n)) - 1].astype(np.int64)
    asked = np.bincount(group, n == 0, minlength=len(starts)) > 0
    offset, entry = np.zeros(len(starts), np.int64), np.full(len(starts), lower)
    closes = np.ones(len(starts), bool)
    for g, piece in pieces.items():
        offset[g] = sum(int(s[1]) for s in piece.before)
        known = [float.fromhex(s[2]) for s in piece.before if s[2]]
        entry[g] = known[-1] if known else lower
        closes[g] = piece.last
        total[g] = sum(int(s[1]) for s in piece.summaries)
        asked[g] = any(s[0] == "1" for s in piece.summaries)
    real = n > 0
    at = np.flatnonzero(real)
    before = np.where(np.append(-1, group[at])[:-1] == group[at], np.append(0.0, value[at])[:-1], entry[group[at]])
    last = entry.copy()
    last[group[at]] = value[at]  # the largest one stays
    shut = np.flatnonzero(closes)
    g = np.concatenate([group[at], shut])
    low, high = np.concatenate([before, last[shut]]), np.concatenate([value[at], np.full(len(shut), upper)])
    rank = np.concatenate([(running - n)[at] + offset[group[at]], total[shut]]).astype(np.int64)
    kept = np.flatnonzero((high > low) & asked[g])
    kept = kept[np.lexsort((rank[kept], g[kept]))]
    return g[kept], low[kept], high[kept], rank[kept], total


def _contenders(g: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, total: np.ndarray, quantile: float, epsilon: ExactNumber) -> tuple[np.ndarray, np.ndarray]:
    """The intervals that may still win in their group, and the bits of their noise."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    many = np.diff(np.append(first, len(g)))
    if epsilon == INFINITY:
        floor = np.array([int(Fraction(quantile) * t // 1) for t in total[g[first]].tolist()], np.int64)
        upto = np.add.reduceat((rank <= np.repeat(floor, many)).astype(np.int64), first)
        near = np.concatenate([(first + upto - 1)[upto > 0], (first + upto)[upto < many]])
        return np.sort(near), np.zeros(len(near), np.uint64)
    target = quantile * total[g].astype(float)
    away, doubt = np.abs(rank - target), 2.0**-51 * (np.abs(target) + rank)
    bits = random_bits(len(g))
    below, above = first_bounds(*float_weights(low, high, away, doubt, rate_of(quantile, epsilon)), bits)
    left = np.flatnonzero(above >= np.repeat(np.maximum.reduceat(below, first), many))
    return left, bits[left]


def winning_intervals(counted: DataFrame, group_keys: DataFrame, quantile: float, lower: float, upper: float, epsilon: ExactNumber) -> DataFrame:
    """The interval that wins in each group of ``group_keys``, as its keys, ``__low`` and ``__high``; evaluated once.

    ``counted`` has the keys, ``__value`` inside the bounds and ``__n``, how often
    it occurs; groups without rows have one interval, the bounds.
    """
    keys = group_keys.columns
    asked = group_keys.select(*map(named, keys), F.lit(None).cast("double").alias("__value"), F.lit(0).cast("long").alias("__n"))
    rows = counted.select(*map(named, keys), F.col("__value").cast("double"), F.col("__n").cast("long")).unionByName(asked)
    ordered = SortedGroups(rows, keys, ["__value"], _summary)
    fields = [ordered.rows.schema[c] for c in keys]
    kind = StructType([*fields, StructField("__low", DoubleType()), StructField("__high", DoubleType()), StructField("__open", IntegerType()), StructField("__rank", LongType()), StructField("__total", LongType()), StructField("__bits", StringType())])
    names = [*keys, "__low", "__high", "__open", "__rank", "__total", "__bits"]

    def choose(table: pa.Table, starts: np.ndarray, pieces: dict[int, Piece]) -> Iterator[pa.RecordBatch]:
        g, low, high, rank, total = _intervals(table, starts, pieces, lower, upper)
        left, bits = _contenders(g, low, high, rank, total, quantile, epsilon)
        cut = np.isin(g[left], list(pieces)) if pieces else np.zeros(len(left), bool)
        picked = np.flatnonzero(cut).tolist()
        first = np.flatnonzero(np.append(True, g[left][1:] != g[left][:-1])[: len(left)]).tolist()
        for a, b in zip(first, [*first[1:], len(left)]):
            if not cut[a]:
                i = left[a:b]
                picked.append(a if b - a == 1 else a + winner(low[i], high[i], rank[i].tolist(), int(total[g[i[0]]]), bits[a:b].tolist(), quantile, epsilon))
        chosen = np.array(picked, np.int64)
        i = left[chosen]
        yield pa.RecordBatch.from_arrays(
            [*key_columns(table, keys, starts[g[i]]), pa.array(low[i]), pa.array(high[i]), pa.array(cut[chosen].astype(np.int32)), pa.array(rank[i]), pa.array(total[g[i]]), pa.array([str(b) for b in bits[chosen].tolist()], pa.string())], names
        )

    found = get_materialized_df(ordered.map(choose, kind))
    done = found.where("__open = 0").select(*map(named, keys), "__low", "__high")
    if not ordered.any_cut:
        return done

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__rank")
        low, high, total = (rows.column(c).to_numpy() for c in ("__low", "__high", "__total"))
        i = winner(low, high, rows.column("__rank").to_pylist(), int(total[0]), [int(b) for b in rows.column("__bits").to_pylist()], quantile, epsilon)
        return rows.slice(i, 1).select([*keys, "__low", "__high"])

    both = StructType([*fields, StructField("__low", DoubleType()), StructField("__high", DoubleType())])
    settled_rows = get_materialized_df(found.where("__open = 1").groupBy(*map(named, keys)).applyInArrow(merge, both))
    return done.unionByName(settled_rows)


def uniform_between(low: str, high: str):
    """A uniform float between two columns, drawn anew for each row."""

    @F.pandas_udf(DoubleType())
    def draw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([uniform(float(x), float(y)) for x, y in zip(a, b)], dtype="float64")

    return draw.asNondeterministic()(F.col(low), F.col(high))
