"""Limits per group that keep the same rows in every run and on every input that has them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType, TimestampNTZType, TimestampType

from quietframe.functions.exact import ExactNumber
from quietframe.operators.grouped import named
from quietframe.plans.core import Transformation
from quietframe.plans.domains import SparkDataFrameDomain, SparkFloatColumnDescriptor
from quietframe.plans.errors import UnsupportedCombinationError, UnsupportedMetricError
from quietframe.plans.metrics import IfGroupedBy, Metric, RootSumOfSquared, SumOf, SymmetricDifference


def _cell(df: DataFrame, column: str) -> Column:
    kind, c = df.schema[column].dataType, named(column)
    if isinstance(kind, (IntegerType, LongType)):
        return F.sha2(F.bin(c), 256)
    if isinstance(kind, (StringType, BinaryType)):
        return F.sha2(c, 256)
    if isinstance(kind, (FloatType, DoubleType)):  # as text: binary digits would cut the fraction and refuse NaN
        return F.sha2((c + F.lit(0.0).cast(kind)).cast("string"), 256)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.sha2(c.cast("string"), 256)
    raise ValueError(f"Can not hash column {column!r} of type {kind}.")


def row_hash(df: DataFrame, columns: Sequence[str], *more: Column) -> Column:
    """A pseudo-random order of rows that depends on their content alone (nulls are left out)."""
    cells = [_cell(df, c) for c in columns] + [F.sha2(F.bin(m), 256) for m in more]
    return F.sha2(F.sha2(F.concat_ws(",", *cells), 256), 256)


#: Parts that a group is first limited in where Spark does not limit it before the shuffle (its window-group limit ends below this threshold).
PARTS, UNLIMITED = 32, 1000


def lowest(df: DataFrame, groups: Sequence[Column], hashed: Column, order: Sequence[Column], threshold: int) -> DataFrame:
    """The first ``threshold`` rows of each group by the hash and the rest of the order.

    Spark limits each group by itself in every task before the shuffle, so what
    meets in one task is at most ``threshold`` rows a group and task.  For large
    thresholds, where it does not, parts of a group are limited first: a row that
    is not among the first of its part is not among the first of its group.

    All rows are sorted for this by 60 bits of the hash, a number instead of a text
    of 64 letters.  Rows of equal numbers have equal ranks and stay; the whole hash
    decides among the few that are left.
    """
    df = df.withColumn("__near", F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"))
    part = F.pmod(F.col("__near"), F.lit(PARTS))
    for extra in ([part], []) if threshold >= UNLIMITED else ([],):
        place = F.rank().over(Window.partitionBy(*groups, *extra).orderBy("__near"))
        df = df.withColumn("__place", place).where(F.col("__place") <= threshold).drop("__place")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("__near", "__hash", *order))
    return df.withColumn("__hash", hashed).withColumn("__place", place).where(F.col("__place") <= threshold).drop("__place", "__hash", "__near")


#: Copies of a row that one task numbers.
COPIES = 1 << 16


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number among rows of equal content, from 1 on.

    Copies are counted first, with partial sums, and then dealt out by number, so
    that a row with very many copies meets in no task; these are numbered in
    stretches of ``COPIES`` by several tasks.
    """
    every = list(map(named, df.columns))
    counted = df.groupBy(*every).agg(F.count(F.lit(1)).alias("__n"))
    number = lambda first, last: F.explode(F.sequence(first, last)).alias(name)
    few = counted.where(F.col("__n") <= COPIES).select(*every, number(F.lit(1).cast("long"), F.col("__n")))
    many = counted.where(F.col("__n") > COPIES).select(*every, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))).alias("__stretch"))
    many = many.repartition(*every, "__stretch").select(*every, number(F.col("__stretch") * COPIES + 1, F.least("__n", (F.col("__stretch") + 1) * COPIES)))
    return few.unionByName(many)


def truncate_large_groups(df: DataFrame, grouping_columns: Sequence[str], threshold: int) -> DataFrame:
    """At most ``threshold`` rows of each group; copies of a row are told apart by their number, so that they do not clump."""
    every = df.columns
    if threshold <= 0:
        return df.limit(0)
    hashed = row_hash(df, every, F.col("__number").cast("long"))
    return lowest(numbered(df, "__number"), list(map(named, grouping_columns)), hashed, list(map(named, every)), threshold).select(*map(named, every))


def drop_large_groups(df: DataFrame, grouping_columns: Sequence[str], threshold: int) -> DataFrame:
    """Only groups of at most ``threshold`` rows.

    The sizes are pre-aggregated and joined back, so that no task holds a large
    group as a window would.
    """
    if not grouping_columns:
        total = df.agg(F.count(F.lit(1)).alias("__size"))
        return df.crossJoin(F.broadcast(total)).where(F.col("__size") <= threshold).select(*map(named, df.columns))
    small = df.groupBy(*map(named, grouping_columns)).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") <= threshold)
    matches = reduce(lambda a, b: a & b, [F.col(f"d.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in grouping_columns])
    return df.alias("d").join(small.alias("s"), matches, "left_semi")


def limit_keys_per_group(df: DataFrame, grouping_columns: Sequence[str], key_columns: Sequence[str], threshold: int) -> DataFrame:
    """Rows of at most ``threshold`` different keys of each group.

    Keys are ranked among the distinct keys, so a large group costs as many
    sorted rows as it has keys.
    """
    both = [*grouping_columns, *key_columns]
    keys = df.select(*map(named, both)).distinct()
    kept = lowest(keys, list(map(named, grouping_columns)), row_hash(df, both), list(map(named, key_columns)), threshold)
    matches = reduce(lambda a, b: a & b, [F.col(f"d.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in both])
    return df.alias("d").join(kept.alias("k"), matches, "left_semi")


def _positive(threshold: int) -> int:
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold < 0:
        raise ValueError(f"The threshold has to be an integer of at least zero: {threshold!r}")
    return threshold


class LimitRowsPerGroup(Transformation):
    """At most so many rows of each group."""

    def __init__(self, input_domain: SparkDataFrameDomain, output_metric: Metric, grouping_column: str, threshold: int):
        input_metric = IfGroupedBy(grouping_column, SymmetricDifference())
        if output_metric not in (SymmetricDifference(), input_metric):
            raise UnsupportedMetricError(output_metric, f"The output metric has to be SymmetricDifference() or {input_metric!r}.")
        super().__init__(input_domain, input_metric, input_domain, output_metric)
        self._grouping_column, self._threshold = grouping_column, _positive(threshold)

    grouping_column = property(lambda self: self._grouping_column)
    threshold = property(lambda self: self._threshold)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * (1 if isinstance(self.output_metric, IfGroupedBy) else self._threshold)

    def __call__(self, sdf):
        return truncate_large_groups(sdf, [self._grouping_column], self._threshold)


class LimitKeysPerGroup(Transformation):
    """Rows of at most so many keys of each group."""

    def __init__(self, input_domain: SparkDataFrameDomain, output_metric: IfGroupedBy, grouping_column: str, key_column: str, threshold: int):
        if grouping_column == key_column:
            raise ValueError("The grouping column and the key column have to differ.")
        if isinstance(input_domain[key_column], SparkFloatColumnDescriptor):
            raise UnsupportedCombinationError((input_domain, key_column), "Keys can not be floats.")
        own = IfGroupedBy(grouping_column, SymmetricDifference())
        legal = (own, IfGroupedBy(key_column, SumOf(own)), IfGroupedBy(key_column, RootSumOfSquared(own)))
        if output_metric not in legal:
            raise UnsupportedMetricError(output_metric, f"The output metric has to be one of {legal}.")
        super().__init__(input_domain, own, input_domain, output_metric)
        self._columns, self._threshold = (grouping_column, key_column), _positive(threshold)

    grouping_column = property(lambda self: self._columns[0])
    key_column = property(lambda self: self._columns[1])
    threshold = property(lambda self: self._threshold)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        inner, k = self.output_metric.inner_metric, ExactNumber(self._threshold)
        factor = k if isinstance(inner, SumOf) else ExactNumber.sqrt(k) if isinstance(inner, RootSumOfSquared) else ExactNumber(1)
        return ExactNumber(d_in) * factor

    def __call__(self, sdf):
        return limit_keys_per_group(sdf, [self._columns[0]], [self._columns[1]], self._threshold)


class LimitRowsPerKeyPerGroup(Transformation):
    """At most so many rows of each key of each group."""

    def __init__(self, input_domain: SparkDataFrameDomain, input_metric: IfGroupedBy, grouping_column: str, key_column: str, threshold: int):
        if grouping_column == key_column:
            raise ValueError("The grouping column and the key column have to differ.")
        if isinstance(input_domain[key_column], SparkFloatColumnDescriptor):
            raise UnsupportedCombinationError((input_domain, key_column), "Keys can not be floats.")
        own = IfGroupedBy(grouping_column, SymmetricDifference())
        outputs = {own: own, IfGroupedBy(key_column, SumOf(own)): SymmetricDifference(), IfGroupedBy(key_column, RootSumOfSquared(own)): IfGroupedBy(key_column, RootSumOfSquared(SymmetricDifference()))}
        if input_metric not in outputs:
            raise UnsupportedMetricError(input_metric, f"The input metric has to be one of {tuple(outputs)}.")
        super().__init__(input_domain, input_metric, input_domain, outputs[input_metric])
        self._columns, self._threshold = (grouping_column, key_column), _positive(threshold)

    grouping_column = property(lambda self: self._columns[0])
    key_column = property(lambda self: self._columns[1])
    threshold = property(lambda self: self._threshold)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * (1 if self.input_metric == self.output_metric else self._threshold)

    def __call__(self, sdf):
        return truncate_large_groups(sdf, list(self._columns), self._threshold)
