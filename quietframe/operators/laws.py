"""Whether a column of noise has the law that it should have: counts of bins in Spark against their masses.

The statistic is Pearson's.  Under the law it is near chi-square of one degree less
than there are bins, which exceeds ``threshold`` with at most the stated
probability (Laurent and Massart, "Adaptive estimation of a quadratic functional by
model selection", 2000, lemma 1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietframe.functions.distributions import discrete_gaussian_cmf, double_sided_geometric_cmf
from quietframe.operators.grouped import named
from quietframe.sources.shared import spread

#: Bins of about equal mass.
BINS = 16
#: Rows for which a piece of work draws.
PIECE = 1024
#: Values that are drawn at once; their arrays of extended floats stay in a core's cache.
BLOCK = 6000


@dataclass(frozen=True)
class Law:
    """Bins of noise: inner edges in ascending order, and the mass of each bin."""

    edges: tuple[float, ...]
    masses: tuple[float, ...]

    @staticmethod
    def of(cdf: Callable[[float], float], scale: float, bins: int = BINS, whole: bool = False) -> Law:
        """The bins of a symmetric law around 0 with this distribution function; edges lie between whole numbers if values are whole."""
        edges = []
        for i in range(1, bins):
            low, high = -scale, scale
            while cdf(low) > i / bins:
                low *= 2
            while cdf(high) < i / bins:
                high *= 2
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if cdf(middle) < i / bins else (low, middle)
            edges.append(math.floor(high) + 0.5 if whole else high)
        edges = sorted(set(edges))
        at = [0.0, *(cdf(e) for e in edges), 1.0]
        return Law(tuple(edges), tuple(b - a for a, b in zip(at, at[1:])))


def laplace(scale: float) -> Law:
    return Law.of(lambda x: 0.5 * math.exp(x / scale) if x < 0 else 1 - 0.5 * math.exp(-x / scale), scale)


def gaussian(sigma: float) -> Law:
    return Law.of(lambda x: 0.5 * math.erfc(-x / sigma / math.sqrt(2)), sigma)


def geometric(alpha: float) -> Law:
    return Law.of(lambda x: float(double_sided_geometric_cmf(math.floor(x), alpha)), alpha, whole=True)


def discrete_gaussian(sigma_squared: float) -> Law:
    return Law.of(lambda x: float(discrete_gaussian_cmf(math.floor(x), sigma_squared)), math.sqrt(sigma_squared), whole=True)


def square_root_gaussian(sigma: float) -> Law:
    def cdf(x: float) -> float:
        t = math.sqrt(abs(x) / sigma)
        tail = 0.5 * (1 + t) * math.exp(-t)
        return tail if x < 0 else 1 - tail

    return Law.of(cdf, sigma)


def exponential_polylogarithmic(d: float, a: float, sigma: float) -> Law:
    mean = 1 / (2 * d)
    beyond = lambda y: 0.5 * math.erfc((y - mean) / math.sqrt(2 * mean))

    def cdf(x: float) -> float:
        tail = 0.5 * beyond(math.log(abs(x) / sigma + a)) / beyond(math.log(a))
        return tail if x < 0 else 1 - tail

    return Law.of(cdf, sigma)


def counts_of(df: DataFrame, column: Column, laws: Sequence[Law]) -> list[list[int]]:
    """How many values are in each bin of each law, from one pass over the cells that all edges make; a row a cell is shuffled from each task."""
    edges = sorted({e for law in laws for e in law.edges})

    def cell(low: int, high: int) -> Column:
        """Which of the cells low to high a value is in, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col("__x") >= F.lit(edges[middle - 1]), cell(middle, high)).otherwise(cell(low, middle - 1))

    found = [[0] * len(law.masses) for law in laws]
    for i, n in df.select(column.alias("__x")).select(cell(0, len(edges)).alias("cell")).groupBy("cell").count().collect():
        for of, law in zip(found, laws):
            of[sum(e in law.edges for e in edges[:i])] += n
    return found


@dataclass(frozen=True)
class Draws:
    """Values that ``draw`` gives, so many for each row, and laws in whose bins they are counted."""

    draw: Callable[[int], np.ndarray]
    times: int
    laws: tuple[Law, ...]


def counts_of_draws(df: DataFrame, columns: Sequence[str], kinds: Sequence[Draws]) -> list[list[list[int]]]:
    """How many of the values drawn for the rows are in each bin of each law, for each kind, from one pass over the rows.

    Rows are counted by the hash of some columns, and tasks get pieces of these
    counts: drawing costs far more than reading, and no row is moved for it.  Values
    are put in their bins by the task that draws them.
    """
    edges = [np.array(sorted({e for law in k.laws for e in law.edges})) for k in kinds]

    def drawn(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros(len(e) + 1, np.int64) for e in edges]
        for piece in pieces:
            rows = sum(piece.column("rows").to_pylist())
            for kind, inner, found in zip(kinds, edges, cells):
                for first in range(0, rows * kind.times, BLOCK):
                    x = kind.draw(min(BLOCK, rows * kind.times - first))
                    found += np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(found))
        for i, found in enumerate(cells):
            yield pa.RecordBatch.from_pydict({"kind": pa.array([i] * len(found), pa.int32()), "cell": pa.array(range(len(found)), pa.int32()), "n": pa.array(found, pa.int64())})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(F.pmod(F.xxhash64(*map(named, columns)), F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    pieces = counted.select("part", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("first"))
    dealt = spread(pieces.select("part", "first", F.least(F.lit(PIECE), F.col("n") - F.col("first")).alias("rows")), "part", "first")
    out = [[[0] * len(law.masses) for law in k.laws] for k in kinds]
    for i, cell, n in dealt.mapInArrow(drawn, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n")).collect():
        for of, law in zip(out[i], kinds[i].laws):
            of[sum(e in law.edges for e in edges[i][:cell])] += n
    return out


def counts(df: DataFrame, column: Column, law: Law) -> list[int]:
    """How many values are in each bin."""
    return counts_of(df, column, [law])[0]


def statistic(found: Sequence[int], law: Law) -> float:
    n = sum(found)
    return sum((c - n * m) ** 2 / (n * m) for c, m in zip(found, law.masses))


def threshold(law: Law, error: float | Fraction = 1e-9) -> float:
    """What the statistic exceeds with at most this probability if the law holds."""
    k, t = len(law.masses) - 1, math.log(1 / error)
    return k + 2 * math.sqrt(k * t) + 2 * t


def fits(df: DataFrame, column: Column, law: Law, error: float = 1e-9) -> bool:
    """Whether values have the law; a right one is refused with at most the given probability."""
    return statistic(counts(df, column, law), law) <= threshold(law, error)
