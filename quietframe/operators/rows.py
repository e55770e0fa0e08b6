"""Operators that act on single rows, and those that give rows names or places."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quietframe.functions.exact import ExactNumber
from quietframe.operators.grouped import SMALL_KEYS, named
from quietframe.operators.truncation import numbered
from quietframe.plans.core import Transformation
from quietframe.plans.domains import ListDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor, SparkStringColumnDescriptor
from quietframe.plans.errors import DomainColumnError, UnsupportedCombinationError, UnsupportedMetricError
from quietframe.plans.metrics import HammingDistance, IfGroupedBy, Metric, RootSumOfSquared, SumOf, SymmetricDifference
from quietframe.sources.shared import Answers


def over_rows(metric: Metric, hamming: bool = True) -> None:
    """Metrics under which an operator on rows does not move inputs apart."""
    inner = getattr(metric, "inner_metric", None)
    plain = isinstance(metric, SymmetricDifference) or (hamming and isinstance(metric, HammingDistance))
    grouped = isinstance(metric, IfGroupedBy) and (inner == SymmetricDifference() or getattr(inner, "inner_metric", None) == SymmetricDifference())
    if not plain and not grouped:
        raise UnsupportedMetricError(metric, f"{metric!r} is not supported here.")


class RowTransformation(Transformation):
    """A transformation of stability 1."""

    def stability_function(self, d_in):
        self.input_metric.validate(d_in)
        return ExactNumber(d_in)


def _some_columns(domain: SparkDataFrameDomain, columns: Sequence[str]) -> None:
    if not columns:
        raise ValueError("At least one column must be specified.")
    if len(set(columns)) != len(columns):
        raise ValueError(f"Duplicate columns: {list(columns)}")
    for c in columns:
        domain[c]


class Select(RowTransformation):
    """Keep some columns, in the order given."""

    def __init__(self, input_domain: SparkDataFrameDomain, metric: Metric, columns: Sequence[str]):
        over_rows(metric)
        _some_columns(input_domain, columns)
        if isinstance(metric, IfGroupedBy) and metric.column not in columns:
            raise UnsupportedCombinationError((metric, list(columns)), f"Column {metric.column!r} of the metric has to stay.")
        super().__init__(input_domain, metric, SparkDataFrameDomain({c: input_domain[c] for c in columns}), metric)
        self._columns = list(columns)

    columns = property(lambda self: list(self._columns))

    def __call__(self, sdf):
        return sdf.select(*map(named, self._columns))


class Rename(RowTransformation):
    """New names for some columns."""

    def __init__(self, input_domain: SparkDataFrameDomain, metric: Metric, rename_mapping: Mapping[str, str]):
        over_rows(metric)
        for old, new in rename_mapping.items():
            input_domain[old]
            if new != old and new in input_domain.schema:
                raise ValueError(f"Cannot rename {old} to {new}: {new} already exists.")
        names = [rename_mapping.get(c, c) for c in input_domain.schema]
        if len(set(names)) != len(names):
            raise ValueError("Several columns get the same name.")
        out = metric
        if isinstance(metric, IfGroupedBy):
            out = IfGroupedBy(rename_mapping.get(metric.column, metric.column), metric.inner_metric)
        super().__init__(input_domain, metric, SparkDataFrameDomain(dict(zip(names, input_domain.schema.values()))), out)
        self._rename_mapping = dict(rename_mapping)

    rename_mapping = property(lambda self: dict(self._rename_mapping))

    def __call__(self, sdf):
        return sdf.select(*[named(c).alias(self._rename_mapping.get(c, c)) for c in self.input_domain.schema])


class Filter(RowTransformation):
    """Keep the rows that meet a SQL condition."""

    def __init__(self, domain: SparkDataFrameDomain, metric: Metric, filter_expr: str):
        over_rows(metric, hamming=False)
        spark = SparkSession.active()
        try:
            empty = spark.createDataFrame([], domain.spark_schema).filter(filter_expr)
            schema = empty.schema
        except Exception as e:
            raise ValueError(f"Invalid filter_expr: {filter_expr!r}: {str(e).splitlines()[0] if str(e) else e}") from e
        assert schema == domain.spark_schema or [f.name for f in schema] == list(domain.schema)
        super().__init__(domain, metric, domain, metric)
        self._filter_expr = filter_expr

    filter_expr = property(lambda self: self._filter_expr)

    def __call__(self, sdf):
        return sdf.filter(self._filter_expr)


def _is_special(kind: str, column: Column) -> Column:
    if kind == "null":
        return column.isNull()
    if kind == "nan":
        return F.coalesce(F.isnan(column), F.lit(False))
    return F.coalesce(F.abs(column) == F.lit(float("inf")), F.lit(False))


class _Special(RowTransformation):
    """Base of what drops or replaces nulls, NaNs and infinities."""

    kind, flag, hamming = "null", "allow_null", False

    def _start(self, domain: SparkDataFrameDomain, metric: Metric, columns: Sequence[str]) -> SparkDataFrameDomain:
        over_rows(metric, self.hamming)
        _some_columns(domain, columns)
        schema = domain.schema
        for c in columns:
            if self.kind != "null" and not isinstance(domain[c], SparkFloatColumnDescriptor):
                raise DomainColumnError(domain, c, f"Column '{c}' is not of floats.")
            if not getattr(domain[c], self.flag):
                warnings.warn(f"Column ({c}) already does not allow {self.kind} values; it stays as it is.", stacklevel=3)
            schema[c] = replace(domain[c], **{self.flag: False})
        return SparkDataFrameDomain(schema)


class _Drop(_Special):
    def __init__(self, input_domain: SparkDataFrameDomain, metric: Metric, columns: Sequence[str]):
        super().__init__(input_domain, metric, self._start(input_domain, metric, columns), metric)
        self._columns = list(columns)

    columns = property(lambda self: list(self._columns))

    def __call__(self, sdf):
        return sdf.filter(reduce(lambda a, b: a & b, [~_is_special(self.kind, named(c)) for c in self._columns]))


class DropNulls(_Drop):
    """Drop rows with nulls in the columns."""


class DropNaNs(_Drop):
    """Drop rows with NaNs in the columns; nulls stay."""

    kind, flag = "nan", "allow_nan"


class DropInfs(_Drop):
    """Drop rows with infinities in the columns."""

    kind, flag = "inf", "allow_inf"


class _Replace(_Special):
    hamming = True

    def __init__(self, input_domain: SparkDataFrameDomain, metric: Metric, replace_map: Mapping[str, Any]):
        output = self._start(input_domain, metric, list(replace_map))
        if self.kind == "null" and isinstance(metric, IfGroupedBy) and metric.column in replace_map:
            raise ValueError(f"Cannot replace nulls in the column {metric.column!r} of the metric.")
        for c, value in replace_map.items():
            if self.kind == "inf" and (not isinstance(value, tuple) or len(value) != 2):
                raise ValueError(f"Column '{c}' needs a pair of replacements.")
            for v in value if self.kind == "inf" else (value,):
                if not output[c].valid_py_value(v):
                    raise ValueError(f"Column '{c}' may not hold {v!r}.")
        super().__init__(input_domain, metric, output, metric)
        self._replace_map = dict(replace_map)

    replace_map = property(lambda self: dict(self._replace_map))

    def _value(self, c: str) -> Column:
        v, kind = self._replace_map[c], self.input_domain[c].data_type
        if self.kind != "inf":
            return F.lit(v).cast(kind)
        return F.when(named(c) < 0, F.lit(v[0]).cast(kind)).otherwise(F.lit(v[1]).cast(kind))

    def __call__(self, sdf):
        return sdf.select(*[F.when(_is_special(self.kind, named(c)), self._value(c)).otherwise(named(c)).alias(c) if c in self._replace_map else named(c) for c in sdf.columns])


class ReplaceNulls(_Replace):
    """Another value for nulls."""


class ReplaceNaNs(_Replace):
    """Another value for NaNs."""

    kind, flag = "nan", "allow_nan"


class ReplaceInfs(_Replace):
    """Other values for negative and positive infinities."""

    kind, flag = "inf", "allow_inf"


class AddUniqueColumn(RowTransformation):
    """A column that names each row by its content and its number among rows of equal content."""

    def __init__(self, input_domain: SparkDataFrameDomain, column: str):
        if column in input_domain.schema:
            raise ValueError(f"Column name ({column}) already exists.")
        output = SparkDataFrameDomain(input_domain.schema | {column: SparkStringColumnDescriptor()})
        super().__init__(input_domain, SymmetricDifference(), output, IfGroupedBy(column, SymmetricDifference()))
        self._column = column

    column = property(lambda self: self._column)

    def __call__(self, sdf):
        cells = [named(c).cast("string") for c in sdf.columns]
        every = sdf.columns
        sdf = numbered(sdf, self._column) if every else sdf.withColumn(self._column, F.monotonically_increasing_id())
        return sdf.select(*map(named, every), F.hex(F.to_json(F.array(*cells, named(self._column).cast("string")))).alias(self._column))


class Partition(RowTransformation):
    """Base of what splits a table into a list of tables."""

    def __init__(self, input_domain, input_metric: Metric, output_metric: Metric, num_partitions: int | None = None, element_domain=None):
        super().__init__(input_domain, input_metric, ListDomain(element_domain or input_domain, num_partitions), output_metric)

    num_partitions = property(lambda self: self.output_domain.length)


#: Rows that a task writes to the folders of parts, which it sorts by folder.
ROWS_A_TASK = 1 << 21


def places_of(counts: Mapping[int, int]) -> tuple[list[tuple[int, int, int]], int]:
    """The first task and the number of tasks of each part, and how many tasks there are: small parts share one."""
    places, tasks, room = [], 0, 0
    for part, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        if n > room:
            own = -(-n // ROWS_A_TASK)
            places.append((part, tasks, own))
            tasks, room = tasks + own, ROWS_A_TASK - n if own == 1 else 0
        else:
            places.append((part, tasks - 1, 1))
            room -= n
    return places, max(1, tasks)


class PartitionByKeys(Partition):
    """The rows of each key, as tables in the keys' order; other rows are dropped."""

    def __init__(self, input_domain: SparkDataFrameDomain, input_metric: Metric, use_l2: bool, keys: Sequence[str], list_values: Sequence[tuple]):
        _some_columns(input_domain, keys)
        values = [v if isinstance(v, tuple) else (v,) for v in list_values]
        if not values:
            raise ValueError("At least one value must be specified.")
        if len(set(values)) != len(values):
            raise ValueError("Partition key values must be unique.")
        for v in values:
            if len(v) != len(keys):
                raise ValueError("Every value needs one part a key.")
            for c, x in zip(keys, v):
                if not input_domain[c].valid_py_value(x):
                    raise ValueError(f"Column '{c}' may not hold {x!r}.")
        aggregate = RootSumOfSquared if use_l2 else SumOf
        inner: Metric = SymmetricDifference()
        if isinstance(input_metric, IfGroupedBy):
            if not isinstance(input_metric.inner_metric, aggregate):
                raise UnsupportedCombinationError((input_metric, use_l2), "The metric does not fit use_l2.")
            inner = input_metric.inner_metric.inner_metric if input_metric.column in keys else input_metric
        elif not isinstance(input_metric, SymmetricDifference):
            raise UnsupportedMetricError(input_metric, "PartitionByKeys takes SymmetricDifference or IfGroupedBy.")
        super().__init__(input_domain, input_metric, aggregate(inner), len(values))
        self._keys, self._values, self._use_l2 = list(keys), values, use_l2

    keys = property(lambda self: list(self._keys))
    list_values = property(lambda self: list(self._values))
    use_l2 = property(lambda self: self._use_l2)

    def __call__(self, sdf: DataFrame) -> KeyedTables:
        """All parts from one pass over the input: rows are kept with their key's number, counted, and written to a folder a part.

        The counts say where rows go: a large part to several tasks, small ones
        together to one, so that a part has few files and no task sorts more than
        about ``ROWS_A_TASK`` rows for its folders, whatever the table's size.
        """
        if len(self._values) == 1:
            same_key = [named(c).eqNullSafe(F.lit(x).cast(self.input_domain[c].data_type)) for c, x in zip(self._keys, self._values[0])]
            return KeyedTables([sdf.filter(reduce(lambda a, b: a & b, same_key))], None)
        spark = sdf.sparkSession
        key_names = [f"__k{i}" for i in range(len(self._keys))]
        schema = StructType([StructField(n, self.input_domain[c].data_type) for n, c in zip(key_names, self._keys)] + [StructField("__part", LongType())])
        numbers = spark.createDataFrame([(*v, i) for i, v in enumerate(self._values)], schema)
        same_key = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"n.`{k}`")) for c, k in zip(self._keys, key_names)]
        known = F.broadcast(numbers) if len(self._values) <= SMALL_KEYS else numbers
        plain = [f"__c{i}" for i in range(len(sdf.columns))]
        marked = sdf.alias("r").join(known.alias("n"), reduce(lambda a, b: a & b, same_key)).select(*[F.col(f"r.`{c}`").alias(p) for c, p in zip(sdf.columns, plain)], F.col("n.__part").alias("__part"))
        kept, path = Answers.new(spark), Answers.new(spark)
        marked.write.parquet(kept)
        found = spark.read.schema(marked.schema).parquet(kept)
        places, tasks = places_of({part: n for part, n in found.groupBy("__part").count().collect()})
        placed = spark.createDataFrame(places, "part long, first int, tasks int")
        at = F.broadcast(placed) if len(places) <= SMALL_KEYS else placed
        task = F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("tasks")).cast("int")
        dealt = found.join(at, F.col("__part") == F.col("part")).select(*plain, "__part", task.alias("__task"))
        dealt.repartitionById(tasks, F.col("__task")).drop("__task").write.partitionBy("__part").parquet(path)
        Answers.remove(spark, [kept])
        whole = spark.read.schema(marked.schema).parquet(path)  # its files are listed once for all parts
        parts = [whole.where(F.col("__part") == i).select(*[F.col(p).alias(c) for c, p in zip(sdf.columns, plain)]) for i in range(len(self._values))]
        return KeyedTables(parts, lambda: Answers.remove(spark, [path]))


class KeyedTables(list):
    """The parts of a table; ``release`` removes what was written for them."""

    def __init__(self, parts: Sequence[DataFrame], remove: Callable[[], None] | None):
        super().__init__(parts)
        self._remove = remove

    def release(self) -> None:
        if self._remove is not None:
            self._remove()
            self._remove = None


class _Stays(RowTransformation):
    def __init__(self, domain: SparkDataFrameDomain, metric: Metric):
        super().__init__(domain, metric, domain, metric)


class Persist(_Stays):
    """Marks the table to be kept."""

    def __call__(self, sdf):
        return sdf.persist()


class Unpersist(_Stays):
    """Lets the table go."""

    def __call__(self, sdf):
        return sdf.unpersist()


class SparkAction(_Stays):
    """Evaluates the table now."""

    def __call__(self, sdf):
        sdf.count()
        return sdf
