"""Grouped tables with explicit, public keys, and exact aggregates."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from quietframe.functions.exact import ExactNumber, ExactNumberInput, validate_exact_number
from quietframe.plans.core import Transformation
from quietframe.plans.domains import Domain, NumpyFloatDomain, NumpyIntegerDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor, SparkGroupedDataFrameDomain, SparkIntegerColumnDescriptor
from quietframe.plans.errors import DomainColumnError, DomainMismatchError, UnsupportedCombinationError, UnsupportedDomainError, UnsupportedMetricError
from quietframe.plans.metrics import AbsoluteDifference, HammingDistance, IfGroupedBy, Metric, OnColumn, RootSumOfSquared, SumOf, SymmetricDifference

#: Values of a key column up to which they are broadcast to make all combinations.
SMALL_KEYS = 100_000

#: Bits of each part of a whole number that are summed on their own: 2**41 rows can not overflow a long.
PART_BITS = 21


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns])


class GroupedDataFrame:
    """A table and its public keys; groups without rows are groups all the same."""

    def __init__(self, dataframe: DataFrame, group_keys: DataFrame):
        self._dataframe, self._group_keys = dataframe, group_keys.distinct() if group_keys.columns else group_keys

    dataframe = property(lambda self: self._dataframe)
    group_keys = property(lambda self: self._group_keys)
    groupby_columns = property(lambda self: self._group_keys.columns)

    def select(self, columns: Sequence[str]) -> GroupedDataFrame:
        """The same groups with fewer columns; grouping columns have to stay."""
        missing = set(self.groupby_columns) - set(columns)
        if missing:
            raise ValueError(f"Grouping columns can not be dropped: {sorted(missing)}")
        return GroupedDataFrame(self._dataframe.select(*map(named, columns)), self._group_keys)

    def aggregate(self, columns: Mapping[str, Column], fill: Mapping[str, Any]) -> DataFrame:
        """Several aggregates in one pass; keys without rows get the fill values.

        The rows are pre-aggregated by key, so that at most one row a key and
        partition is shuffled, and the keys are joined to the result.
        """
        keys = self.groupby_columns
        if not keys:
            return self._dataframe.agg(*[F.coalesce(c, F.lit(fill[n])).alias(n) if fill.get(n) is not None else c.alias(n) for n, c in columns.items()])
        done = self._dataframe.groupBy(*map(named, keys)).agg(F.lit(True).alias("__found"), *[c.alias(n) for n, c in columns.items()])
        out = self._group_keys.alias("k").join(done.alias("a"), same("k", "a", keys), "left")
        return out.select(*[F.col(f"k.`{c}`").alias(c) for c in keys], *[F.when(F.col("a.__found"), F.col(f"a.`{n}`")).otherwise(F.lit(fill[n])).alias(n) for n in columns])

    def agg(self, func: Column, fill_value: Any, name: str | None = None) -> DataFrame:
        """One aggregate."""
        if name is None:
            name = self._dataframe.limit(0).agg(func).columns[0]
        return self.aggregate({name: func}, {name: fill_value})

    def apply_in_pandas(self, aggregation_function: Callable[[pd.DataFrame], pd.DataFrame], aggregation_output_schema: StructType) -> DataFrame:
        """A pandas function of each group; groups without rows get an empty frame."""
        keys = self.groupby_columns
        value_columns = [c for c in self._dataframe.columns if c not in keys]
        if keys:
            rows = self._group_keys.alias("k").join(self._dataframe.withColumn("__row", F.lit(True)).alias("d"), same("k", "d", keys), "left").select(*[F.col(f"k.`{c}`").alias(c) for c in keys], *[F.col(f"d.`{c}`").alias(c) for c in value_columns], F.col("d.__row").alias("__row"))
        else:
            one = self._dataframe.sparkSession.createDataFrame([(None,)], "`__row` boolean")
            rows = self._dataframe.withColumn("__row", F.lit(True)).unionByName(one, allowMissingColumns=True)
        schema = StructType([f for f in self._group_keys.schema] + list(aggregation_output_schema))
        types = {f.name: f.dataType for f in self._dataframe.schema}

        def one_group(frame: pd.DataFrame) -> pd.DataFrame:
            head = frame[keys].iloc[:1].reset_index(drop=True)
            body = frame[frame["__row"].notna()][value_columns].reset_index(drop=True)
            if not len(body):
                body = body.astype({c: {"long": "int64", "integer": "int32", "double": "float64", "float": "float32"}.get(types[c].typeName(), "object") for c in value_columns})
            out = aggregation_function(body).reset_index(drop=True)
            return pd.concat([pd.concat([head] * len(out), ignore_index=True), out], axis=1) if keys else out

        return rows.groupBy(*map(named, keys)).applyInPandas(one_group, schema)

    def get_groups(self) -> dict[Row, DataFrame]:
        """Each group as a table of its own, for small key tables (tests, distances)."""
        keys = self.groupby_columns
        out = {}
        for key in self._group_keys.collect():
            condition = reduce(lambda a, b: a & b, [named(c).eqNullSafe(F.lit(key[c])) for c in keys], F.lit(True))
            out[key] = self._dataframe.where(condition).drop(*[f"{c}" for c in keys])
        return out


def _grouped_metric(input_metric: Metric, use_l2: bool) -> Metric:
    inner = input_metric.inner_metric if isinstance(input_metric, IfGroupedBy) else None
    if inner is not None:
        return inner
    return (RootSumOfSquared if use_l2 else SumOf)(SymmetricDifference())


class GroupBy(Transformation):
    """Attach public keys to a table."""

    def __init__(self, input_domain: SparkDataFrameDomain, input_metric: Metric, use_l2: bool, group_keys: DataFrame):
        keys = group_keys.columns
        if not isinstance(input_metric, (HammingDistance, SymmetricDifference, IfGroupedBy)):
            raise UnsupportedMetricError(input_metric, "GroupBy takes HammingDistance, SymmetricDifference or IfGroupedBy.")
        if isinstance(input_metric, IfGroupedBy):
            if input_metric.column not in keys:
                raise UnsupportedCombinationError((input_metric, keys), f"The column {input_metric.column!r} of the metric has to be a grouping column.")
            if not isinstance(input_metric.inner_metric, RootSumOfSquared if use_l2 else SumOf):
                raise UnsupportedCombinationError((input_metric, use_l2), "The metric does not fit use_l2.")
        for c in keys:
            input_domain[c]
        SparkDataFrameDomain({c: input_domain[c] for c in keys}).validate(group_keys)
        output = SparkGroupedDataFrameDomain(input_domain.schema, keys)
        super().__init__(input_domain, input_metric, output, _grouped_metric(input_metric, use_l2))
        self._use_l2, self._group_keys = use_l2, group_keys

    use_l2 = property(lambda self: self._use_l2)
    group_keys = property(lambda self: self._group_keys)
    groupby_columns = property(lambda self: self._group_keys.columns)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * (2 if isinstance(self.input_metric, HammingDistance) else 1)

    def __call__(self, sdf: DataFrame) -> GroupedDataFrame:
        return GroupedDataFrame(sdf, self._group_keys)


def compute_full_domain_df(column_domains: Mapping[str, Sequence[Any]]) -> DataFrame:
    """All combinations of the values, as a distributed product."""
    spark = SparkSession.active()
    if not column_domains:
        return spark.createDataFrame([()], StructType([]))
    parts = [spark.createDataFrame([(v,) for v in values], StructType([StructField(c, _key_type(values), None in values)])) for c, values in column_domains.items()]
    small = [len(values) <= SMALL_KEYS for values in column_domains.values()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b[0]) if b[1] else b[0]), zip(parts[1:], small[1:]), parts[0])


def _key_type(values: Sequence[Any]):
    kinds = {type(v) for v in values if v is not None}
    for kind, spark_type in ((str, StringType()), (int, LongType()), (datetime.date, DateType())):
        if kinds <= {kind}:
            return spark_type
    raise ValueError(f"Keys have to be strings, integers or dates of one type, not {sorted(k.__name__ for k in kinds)}.")


def validate_groupby_domains(groupby_domains: Mapping[str, Sequence[Any]], input_domain: SparkDataFrameDomain) -> None:
    """Values of each column: some, none twice, all allowed."""
    for c, values in groupby_domains.items():
        descriptor = input_domain[c]
        if not values:
            raise ValueError(f"Column '{c}' has no values.")
        if len(set(values)) != len(values):
            raise ValueError(f"Column '{c}' has duplicate values.")
        for v in values:
            if not descriptor.valid_py_value(v):
                raise ValueError(f"Column '{c}' may not hold {v!r}.")


def _typed(keys: DataFrame, input_domain: SparkDataFrameDomain) -> DataFrame:
    return keys.select(*[named(c).cast(input_domain[c].data_type).alias(c) for c in keys.columns])


def create_groupby_from_column_domains(input_domain: SparkDataFrameDomain, input_metric: Metric, use_l2: bool, column_domains: Mapping[str, Sequence[Any]]) -> GroupBy:
    """Keys are all combinations of the columns' values."""
    validate_groupby_domains(column_domains, input_domain)
    return GroupBy(input_domain, input_metric, use_l2, _typed(compute_full_domain_df(column_domains), input_domain))


def create_groupby_from_list_of_keys(input_domain: SparkDataFrameDomain, input_metric: Metric, use_l2: bool, groupby_columns: Sequence[str], keys: Sequence[tuple]) -> GroupBy:
    """Keys are given one by one."""
    if len(set(keys)) != len(keys):
        raise ValueError("Duplicate keys.")
    for key in keys:
        for c, v in zip(groupby_columns, key, strict=True):
            if not input_domain[c].valid_py_value(v):
                raise ValueError(f"Column '{c}' may not hold {v!r}.")
    schema = StructType([StructField(c, input_domain[c].data_type, input_domain[c].allow_null) for c in groupby_columns])
    return GroupBy(input_domain, input_metric, use_l2, SparkSession.active().createDataFrame(list(keys), schema))


# -- exact aggregates


def clip(column: Column, lower: float, upper: float) -> Column:
    """The value inside the bounds; null stays null."""
    return F.when(column < lower, F.lit(lower)).when(column > upper, F.lit(upper)).otherwise(column)


def distinct_count(columns: Sequence[str]) -> Column:
    """How many different rows, nulls counted as values; nothing is collected."""
    return F.count_distinct(F.struct(*map(named, columns))) if columns else F.least(F.count(F.lit(1)), F.lit(1))


def clip_bounds(descriptor, lower: ExactNumber, upper: ExactNumber) -> tuple[Any, Any]:
    low, high = lower.to_float(True), upper.to_float(False)
    return (int(low), int(high)) if isinstance(descriptor, SparkIntegerColumnDescriptor) else (float(low), float(high))


def sum_of(column: Column, whole: bool, most: int | float) -> Column:
    """The sum of numbers of at most ``most`` in size; it can not fail on any rows.

    Whole numbers are summed in parts of ``PART_BITS`` bits, put together as a
    decimal, and a sum beyond the range of longs is the range's end.
    """
    parts = -(-(int(most).bit_length() + 1) // PART_BITS) if whole else 1
    if not whole or parts == 1:
        return F.sum(column)
    wide = lambda c: c.cast("decimal(20,0)").cast("decimal(38,0)")
    mask = F.lit((1 << PART_BITS) - 1).cast("long")
    total = wide(F.sum(F.shiftright(column, PART_BITS * (parts - 1))))
    for k in reversed(range(parts - 1)):
        total = (total * F.lit(1 << PART_BITS)).cast("decimal(38,0)") + wide(F.sum(F.shiftright(column, PART_BITS * k).bitwiseAND(mask)))
    top = F.lit(2**63 - 1)
    return F.least(F.greatest(total, (-top - 1).cast("decimal(38,0)")), top.cast("decimal(38,0)")).cast("long")


def whole_bounds(low: ExactNumber, high: ExactNumber, what: str) -> None:
    """Refuse bounds between which numbers or their distances do not fit a long; decided by the bounds alone."""
    if max(abs(low), abs(high), high - low) > 2**62:
        raise ValueError(f"The bounds are too far apart for {what} of whole numbers.")


class _Aggregate(Transformation):
    """A number of a table, or a column of numbers of a grouped one."""

    grouped = False

    def __init__(self, input_domain: Domain, input_metric: Metric, result: Domain, column: str | None = None, descriptor=None):
        if not self.grouped:
            if not isinstance(input_domain, SparkDataFrameDomain):
                raise UnsupportedDomainError(input_domain, f"{type(self).__name__} takes tables.")
            if not isinstance(input_metric, (SymmetricDifference, HammingDistance)):
                raise UnsupportedMetricError(input_metric, f"{type(self).__name__} takes SymmetricDifference or HammingDistance.")
            super().__init__(input_domain, input_metric, result, AbsoluteDifference())
            return
        if not isinstance(input_domain, SparkGroupedDataFrameDomain):
            raise UnsupportedDomainError(input_domain, f"{type(self).__name__} takes grouped tables.")
        if not isinstance(input_metric, (SumOf, RootSumOfSquared)) or input_metric.inner_metric != SymmetricDifference():
            raise UnsupportedMetricError(input_metric, f"{type(self).__name__} takes SumOf or RootSumOfSquared of SymmetricDifference.")
        if column in input_domain.groupby_columns:
            raise ValueError(f"Invalid output column: {column!r} is a grouping column.")
        output = SparkDataFrameDomain({c: input_domain[c] for c in input_domain.groupby_columns} | {column: descriptor})
        super().__init__(input_domain, input_metric, output, OnColumn(column, type(input_metric)(AbsoluteDifference())))
        self._column = column

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * (2 if isinstance(self.input_metric, HammingDistance) else 1)


class Count(_Aggregate):
    """Rows of a table."""

    def __init__(self, input_domain, input_metric):
        super().__init__(input_domain, input_metric, NumpyIntegerDomain())

    def __call__(self, df):
        return np.int64(df.count())


class CountDistinct(_Aggregate):
    """Different rows of a table."""

    def __init__(self, input_domain, input_metric):
        super().__init__(input_domain, input_metric, NumpyIntegerDomain())

    def __call__(self, df):
        return np.int64(df.distinct().count())


class CountGrouped(_Aggregate):
    """Rows of each group."""

    grouped, default = True, "count"

    def __init__(self, input_domain, input_metric, count_column: str | None = None):
        super().__init__(input_domain, input_metric, None, count_column or self.default, SparkIntegerColumnDescriptor())

    count_column = property(lambda self: self._column)

    def _expression(self) -> Column:
        return F.count(F.lit(1))

    def __call__(self, grouped_dataframe):
        return grouped_dataframe.aggregate({self._column: self._expression()}, {self._column: 0})


class CountDistinctGrouped(CountGrouped):
    """Different rows of each group."""

    default = "count_distinct"

    def _expression(self):
        return distinct_count(list(self.input_domain.get_group_domain().schema))


class _Sum(_Aggregate):
    def _set(self, input_domain, measure_column: str, lower: ExactNumberInput, upper: ExactNumberInput):
        descriptor = input_domain[measure_column]
        if not isinstance(descriptor, (SparkIntegerColumnDescriptor, SparkFloatColumnDescriptor)):
            raise DomainColumnError(input_domain, measure_column, f"Column '{measure_column}' is not numeric.")
        if descriptor.allow_null:
            raise DomainColumnError(input_domain, measure_column, f"Column '{measure_column}' may hold nulls; drop or replace them first.")
        if isinstance(descriptor, SparkFloatColumnDescriptor) and descriptor.allow_nan:
            raise DomainColumnError(input_domain, measure_column, f"Column '{measure_column}' may hold NaNs; drop or replace them first.")
        low, high = ExactNumber(lower), ExactNumber(upper)
        if low > high:
            raise ValueError("Lower clipping bound is larger than upper clipping bound.")
        whole = isinstance(descriptor, SparkIntegerColumnDescriptor)
        for bound in (low, high):
            if not bound.is_finite:
                raise ValueError("Clipping bounds have to be finite.")
            validate_exact_number(bound, allow_nonintegral=not whole, minimum=-(2**970), maximum=2**970)
        if whole:
            whole_bounds(low, high, "a sum")
        self._measure, self._bounds = measure_column, (low, high)
        return descriptor

    measure_column = property(lambda self: self._measure)
    lower = property(lambda self: self._bounds[0])
    upper = property(lambda self: self._bounds[1])

    def _expression(self) -> Column:
        descriptor = self.input_domain[self._measure]
        low, high = clip_bounds(descriptor, *self._bounds)
        return sum_of(clip(named(self._measure), low, high), isinstance(descriptor, SparkIntegerColumnDescriptor), max(abs(low), abs(high)))

    @property
    def _sensitivity(self) -> ExactNumber:
        return max(abs(self.lower), abs(self.upper))


class Sum(_Sum):
    """The sum of clipped values."""

    def __init__(self, input_domain, input_metric, measure_column: str, lower: ExactNumberInput, upper: ExactNumberInput):
        if not isinstance(input_domain, SparkDataFrameDomain):
            raise UnsupportedDomainError(input_domain, "Sum takes tables.")
        descriptor = self._set(input_domain, measure_column, lower, upper)
        result = NumpyIntegerDomain(size=64) if isinstance(descriptor, SparkIntegerColumnDescriptor) else NumpyFloatDomain(size=64)
        super().__init__(input_domain, input_metric, result)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * (self.upper - self.lower if isinstance(self.input_metric, HammingDistance) else self._sensitivity)

    def __call__(self, df):
        total = df.agg(F.coalesce(self._expression(), F.lit(0))).first()[0]
        return self.output_domain.carrier_type(total)


class SumGrouped(_Sum):
    """The sum of clipped values of each group."""

    grouped = True

    def __init__(self, input_domain, input_metric, measure_column: str, lower: ExactNumberInput, upper: ExactNumberInput, sum_column: str | None = None):
        if not isinstance(input_domain, SparkGroupedDataFrameDomain):
            raise UnsupportedDomainError(input_domain, "SumGrouped takes grouped tables.")
        descriptor = self._set(input_domain, measure_column, lower, upper)
        if measure_column in input_domain.groupby_columns:
            raise DomainColumnError(input_domain, measure_column, "The measure column can not be a grouping column.")
        out = SparkIntegerColumnDescriptor() if isinstance(descriptor, SparkIntegerColumnDescriptor) else SparkFloatColumnDescriptor()
        super().__init__(input_domain, input_metric, None, sum_column or f"sum({measure_column})", out)

    sum_column = property(lambda self: self._column)

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in) * self._sensitivity

    def __call__(self, grouped_dataframe):
        whole = isinstance(self.output_domain[self._column], SparkIntegerColumnDescriptor)
        return grouped_dataframe.aggregate({self._column: self._expression()}, {self._column: 0 if whole else 0.0})


def _by_domain(input_domain, plain, grouped):
    if isinstance(input_domain, SparkGroupedDataFrameDomain):
        return grouped
    if isinstance(input_domain, SparkDataFrameDomain):
        return plain
    raise DomainMismatchError((input_domain,), "The domain has to be of tables or grouped tables.")


def create_count_aggregation(input_domain, input_metric, count_column: str | None = None):
    """Count or CountGrouped, as the domain asks."""
    kind = _by_domain(input_domain, Count, CountGrouped)
    return kind(input_domain, input_metric) if kind is Count else kind(input_domain, input_metric, count_column)


def create_count_distinct_aggregation(input_domain, input_metric, count_column: str | None = None):
    """CountDistinct or CountDistinctGrouped, as the domain asks."""
    kind = _by_domain(input_domain, CountDistinct, CountDistinctGrouped)
    return kind(input_domain, input_metric) if kind is CountDistinct else kind(input_domain, input_metric, count_column)


def create_sum_aggregation(input_domain, input_metric, measure_column: str, lower: ExactNumberInput, upper: ExactNumberInput, sum_column: str | None = None):
    """Sum or SumGrouped, as the domain asks."""
    kind = _by_domain(input_domain, Sum, SumGrouped)
    arguments = (input_domain, input_metric, measure_column, lower, upper)
    return kind(*arguments) if kind is Sum else kind(*arguments, sum_column)
