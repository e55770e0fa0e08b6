"""Queries of the remaining operators and functions, with their SQL.

Tables pass through the operators whole.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quietframe import catalogue
from quietframe.catalogue import SD, dense, fixed_loss, hashed, lines, one_row, query, truncated
from quietframe.functions import batches
from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.operators import grouped, laws, maps, noise, per_record, quantiles, releases, rows, tables, truncation
from quietframe.operators.noise import NoiseMechanism
from quietframe.plans import core, domains, errors, interactive, measures, metrics
from quietframe.plans.domains import DictDomain, ListDomain, NumpyIntegerDomain, PandasDataFrameDomain, PandasSeriesDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor, SparkIntegerColumnDescriptor, SparkRowDomain, SparkStringColumnDescriptor
from quietframe.plans.measures import ApproxDP, PureDP, RhoZCDP
from quietframe.plans.metrics import AddRemoveKeys, DictMetric, HammingDistance, IfGroupedBy, RootSumOfSquared, SumOf
from quietframe.sources import shared
from quietframe.sources.shared import read_table


def rows_of(spark, schema: str, values) -> DataFrame:
    fields = list(StructType.fromDDL(schema)) if "," in schema or " " in schema else []
    plain = lambda v, f: float(v) if isinstance(f.dataType, DoubleType) and v is not None else v.item() if hasattr(v, "item") else v
    return spark.createDataFrame([tuple(map(plain, r, fields)) for r in values], schema)


# -- operators on one table of a dictionary


def _one_table(df: DataFrame, domain: SparkDataFrameDomain, kind, key: str, *arguments) -> DataFrame:
    """The table that a kind of TransformValue makes of an entry, read from the dictionary it gives."""
    t = kind(DictDomain({"t": domain}), AddRemoveKeys({"t": key}), "t", "new", *arguments)
    return t({"t": df})["new"]


def _special_value(name: str, kind, argument) -> None:
    def run(spark, sf_dir):
        df, domain = catalogue.special(spark, sf_dir)
        return catalogue.as_text(_one_table(df, domain, kind, "l_orderkey", argument))

    run.__name__ = f"{name}_value"
    query(catalogue.oracle_sql()[name])(run)


_special_value("drop_nulls", tables.DropNullsValue, ["v"])
_special_value("drop_nans", tables.DropNaNsValue, ["v"])
_special_value("drop_infs", tables.DropInfsValue, ["v"])
_special_value("replace_nulls", tables.ReplaceNullsValue, {"v": -1.0})
_special_value("replace_nans", tables.ReplaceNaNsValue, {"v": -2.0})
_special_value("replace_infs", tables.ReplaceInfsValue, {"v": (-3.0, 3.0)})


@query("SELECT l_orderkey, l_returnflag FROM lineitem")
def select_value(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_returnflag", "l_quantity")
    return _one_table(df, dense(df), tables.SelectValue, "l_orderkey", ["l_orderkey", "l_returnflag"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def persist_values(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_returnflag")
    domain, metric = DictDomain({"t": dense(df)}), AddRemoveKeys({"t": "l_orderkey"})
    steps, old = [], "t"
    for kind, new in ((tables.PersistValue, "kept"), (tables.SparkActionValue, "run"), (tables.UnpersistValue, "freed")):
        steps.append(kind(domain, metric, old, new))
        domain, metric, old = steps[-1].output_domain, steps[-1].output_metric, new
    return tables.chain(*steps)({"t": df})["freed"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_quantity * 2 AS double_quantity FROM lineitem")
def map_value(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_quantity")
    source = dense(df).schema
    f = maps.RowToRowTransformation(SparkRowDomain(source), SparkRowDomain(dict(source) | {"double_quantity": SparkFloatColumnDescriptor()}), {"double_quantity": F.col("l_quantity") * 2}, True)
    return _one_table(df, dense(df), tables.MapValue, "l_orderkey", f).select("l_orderkey", "double_quantity")


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, least(l_linenumber, 2) + 1))::BIGINT AS part FROM lineitem")
def flat_map_value(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber")
    parts = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.struct(i.cast("long").alias("part")))
    return _one_table(df, dense(df), tables.FlatMapValue, "l_orderkey", catalogue._pairs(df, parts), 2)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def flat_map_by_key_value(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    source = dense(df).schema
    f = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(source)), ListDomain(SparkRowDomain({"n": SparkIntegerColumnDescriptor()})), lambda rs: [{"n": len(rs)}])
    return _one_table(df, dense(df), tables.FlatMapByKeyValue, "o_custkey", f)


@query(f"SELECT nationkey, c_custkey, n_name FROM {catalogue._CUSTOMERS} JOIN nation ON nationkey = n_nationkey")
def public_join_value(spark, sf_dir):
    df, public = catalogue.customers(spark, sf_dir), catalogue.nations(spark, sf_dir)
    return _one_table(df, dense(df), tables.PublicJoinValue, "c_custkey", public)


_EVENT_KEYS = f"(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY {hashed(['user_id', 'event_type'], {'event_type'})}, event_type) AS place FROM (SELECT DISTINCT user_id, event_type FROM events))"
_TWO_KEYS = f"SELECT user_id, event_type, event_id FROM events WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM {_EVENT_KEYS} WHERE place <= 2)"
_THREE_ROWS = truncated("events", ["user_id", "event_type", "event_id"], "user_id, event_type", 3, {"event_type"})


def _events(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")


@query(_TWO_KEYS)
def limit_keys_value(spark, sf_dir):
    df = _events(spark, sf_dir)
    return _one_table(df, dense(df), tables.LimitKeysPerGroupValue, "user_id", "event_type", 2)


@query(_THREE_ROWS)
def limit_rows_per_key_value(spark, sf_dir):
    df = _events(spark, sf_dir)
    return _one_table(df, dense(df), tables.LimitRowsPerKeyPerGroupValue, "user_id", "event_type", 3)


@query(_TWO_KEYS)
def limit_keys_l2(spark, sf_dir):
    df = _events(spark, sf_dir)
    return truncation.LimitKeysPerGroup(dense(df), IfGroupedBy("event_type", RootSumOfSquared(IfGroupedBy("user_id", SD))), "user_id", "event_type", 2)(df)


# -- dictionaries


def _pair(spark, sf_dir):
    data = {"o": read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "c": read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")}
    return data, DictDomain({k: dense(v) for k, v in data.items()}), DictMetric({k: SD for k in data})


def _counted(found: dict) -> DataFrame:
    parts = [df.agg(F.lit(str(k)).alias("part"), F.count("*").alias("n")) for k, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'only' AS part, count(*) AS n FROM orders")
def create_dict(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return _counted(tables.CreateDictFromValue(dense(df), SD, "only")(df))


@query("SELECT 'c' AS part, count(*) AS n FROM customer")
def subset(spark, sf_dir):
    data, domain, metric = _pair(spark, sf_dir)
    return _counted(tables.Subset(domain, metric, ["c"])(data))


def _open(data, domain):
    return rows.Filter(domain["o"], SD, "o_orderstatus = 'O'")


@query("SELECT 'o' AS part, count(*) AS n FROM orders UNION ALL SELECT 'c', count(*) FROM customer UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'")
def augment_dict(spark, sf_dir):
    data, domain, metric = _pair(spark, sf_dir)
    one = tables.GetValue(domain, metric, "o")
    part = one | _open(data, domain) | tables.CreateDictFromValue(domain["o"], SD, "open")
    return _counted(tables.AugmentDictTransformation(part)(data))


@query("SELECT 'o' AS part, count(*) AS n FROM orders UNION ALL SELECT 'c', count(*) FROM customer UNION ALL SELECT 'new', count(*) FROM orders WHERE o_orderstatus = 'O'")
def copy_and_transform_value(spark, sf_dir):
    data, domain, metric = _pair(spark, sf_dir)
    return _counted(tables.create_copy_and_transform_value(domain, metric, "o", "new", _open(data, domain), lambda d_in, d_out: d_in)(data))


@query("SELECT 'open' AS part, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'all', count(*) FROM orders")
def apply_dict_of_transformations(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    d = dense(df)
    return _counted(tables.create_apply_dict_of_transformations({"open": rows.Filter(d, SD, "o_orderstatus = 'O'"), "all": core.Identity(SD, d)})(df))


@query("SELECT 'o' AS part, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'c', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def transform_all_values(spark, sf_dir):
    data, domain, metric = _pair(spark, sf_dir)
    return _counted(tables.create_transform_all_values({"o": _open(data, domain), "c": rows.Filter(domain["c"], SD, "c_mktsegment = 'BUILDING'")})(data))


# -- aggregates without noise


@query("SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_quantity FROM lineitem)) AS differing, (SELECT sum(least(greatest(l_quantity, 5), 40)) FROM lineitem) AS total, (SELECT sum(least(l_linenumber, 4))::BIGINT FROM lineitem) AS whole")
def aggregations(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linenumber", "l_quantity")
    d = dense(df)
    parts = {"n": grouped.create_count_aggregation(d, SD), "differing": grouped.create_count_distinct_aggregation(d, SD), "total": grouped.create_sum_aggregation(d, SD, "l_quantity", 5, 40), "whole": grouped.create_sum_aggregation(d, SD, "l_linenumber", 0, 4)}
    return one_row(spark, **{k: t(df) for k, t in parts.items()})


def _grouping(df: DataFrame, domain: SparkDataFrameDomain):
    return grouped.create_groupby_from_list_of_keys(domain, SD, False, ["l_returnflag"], [("A",), ("N",), ("R",), ("X",)])


@query("SELECT f AS l_returnflag, coalesce(n, 0) AS count, coalesce(d, 0) AS count_distinct, coalesce(t, 0) AS total FROM (VALUES ('A'), ('N'), ('R'), ('X')) k(f) LEFT JOIN (SELECT l_returnflag, count(*) AS n, count(DISTINCT (l_linenumber, l_quantity)) AS d, sum(least(greatest(l_quantity, 5), 40)) AS t FROM lineitem GROUP BY 1) g ON g.l_returnflag = f")
def grouped_aggregations(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linenumber", "l_quantity")
    group = _grouping(df, dense(df))
    of, metric, table = group.output_domain, group.output_metric, group(df)
    out = grouped.create_count_aggregation(of, metric)(table)
    for t in (grouped.create_count_distinct_aggregation(of, metric), grouped.create_sum_aggregation(of, metric, "l_quantity", 5, 40, "total")):
        out = out.join(t(table), "l_returnflag")
    return out


# -- pandas aggregates of groups, quantile intervals


class Extremes(releases.MergeableAggregate):
    """The least or the largest value of a series; without privacy, to show how aggregates are applied."""

    def __init__(self, domain, largest: bool):
        super().__init__(domain, SD, PureDP(), StructType([StructField("x", DoubleType())]))
        self._largest = largest

    def privacy_function(self, d_in):
        return INFINITY

    def init(self):
        return None

    def update(self, state, data):
        return state if not len(data) else self.merge(state, float(data.max() if self._largest else data.min()))

    def merge(self, state, other):
        return other if state is None else state if other is None else (max if self._largest else min)(state, other)

    def finish(self, state):
        return -1.0 if state is None else state


@query("SELECT f AS l_returnflag, coalesce(low, -1) AS l_quantity, coalesce(high, -1) AS l_extendedprice FROM (VALUES ('A'), ('N'), ('R'), ('X')) k(f) LEFT JOIN (SELECT l_returnflag, min(l_quantity) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1) g ON g.l_returnflag = f")
def apply_in_pandas(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_quantity", "l_extendedprice")
    group = _grouping(df, dense(df))
    series = {c: PandasSeriesDomain(dense(df)[c].to_numpy_domain()) for c in ("l_quantity", "l_extendedprice")}
    f = releases.AggregateByColumn(PandasDataFrameDomain(series), {"l_quantity": Extremes(series["l_quantity"], False), "l_extendedprice": Extremes(series["l_extendedprice"], True)})
    return releases.ApplyInPandas(group.output_domain, SumOf(SD), f)(group(df))


class Spread(releases.MergeableAggregate):
    """Largest less least value of a series, taken in parts; without privacy, like ``Extremes``."""

    def __init__(self, domain):
        super().__init__(domain, SD, PureDP(), StructType([StructField("x", DoubleType())]))

    def privacy_function(self, d_in):
        return INFINITY

    def init(self):
        return None

    def update(self, state, data):
        return state if not len(data) else self.merge(state, (float(data.min()), float(data.max())))

    def merge(self, state, other):
        return other if state is None else state if other is None else (min(state[0], other[0]), max(state[1], other[1]))

    def finish(self, state):
        return -1.0 if state is None else state[1] - state[0]


@query("SELECT f AS l_returnflag, coalesce(a, -1) AS l_quantity, coalesce(b, -1) AS l_extendedprice FROM (VALUES ('A'), ('N'), ('R'), ('X')) k(f) LEFT JOIN (SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS a, max(l_extendedprice) - min(l_extendedprice) AS b FROM lineitem GROUP BY 1) g ON g.l_returnflag = f")
def apply_in_parts(spark, sf_dir):
    """Aggregates of groups from states that each task makes of its rows."""
    df = lines(spark, sf_dir, "l_returnflag", "l_quantity", "l_extendedprice")
    group = _grouping(df, dense(df))
    series = {c: PandasSeriesDomain(dense(df)[c].to_numpy_domain()) for c in ("l_quantity", "l_extendedprice")}
    f = releases.AggregateByColumn(PandasDataFrameDomain(series), {c: Spread(d) for c, d in series.items()})
    return releases.ApplyInPandas(group.output_domain, SumOf(SD), f)(group(df))


@query("SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def flat_map_by_key_stream(spark, sf_dir):
    """A function that reads the rows of a key one by one: a third of the table and more a key, in bounded memory."""
    df = lines(spark, sf_dir, "l_returnflag", "l_linenumber").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))

    def count_and_sum(stream):
        n = total = 0
        for r in stream:
            n, total = n + 1, total + r.l_linenumber
        return [{"n": n, "total": total}]

    target = {"n": SparkIntegerColumnDescriptor(), "total": SparkIntegerColumnDescriptor()}
    f = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(dense(df).schema)), ListDomain(SparkRowDomain(target)), count_and_sum, streaming=True)
    return maps.FlatMapByKey(IfGroupedBy("l_returnflag", SD), f)(df)


@query("SELECT l_orderkey % 50 AS k, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def partition_by_many_keys(spark, sf_dir):
    """Fifty parts of one pass, each read from its own folder."""
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber").select((F.col("l_orderkey") % 50).alias("k"), F.col("l_linenumber").cast("long").alias("x"))
    parts = rows.PartitionByKeys(dense(df), SD, False, ["k"], [(k,) for k in range(50)])(df)
    return reduce(DataFrame.unionByName, [p.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("total")) for p in parts])


@query("SELECT l_linestatus, min(r) AS rank FROM (SELECT l_linestatus, r, sum(n) OVER (PARTITION BY l_linestatus ORDER BY r) AS upto, sum(n) OVER (PARTITION BY l_linestatus) AS total FROM (SELECT l_linestatus, l_orderkey AS r, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE upto >= trunc(total * 0.6::DOUBLE) GROUP BY 1")
def sparse_vector_prefix_sums(spark, sf_dir):
    """The first order at which six tenths of the lines of a status are passed, from ranges of orders."""
    df = lines(spark, sf_dir, "l_linestatus", "l_orderkey").groupBy("l_linestatus", F.col("l_orderkey").alias("rank")).agg(F.count("*").alias("n"))
    return releases.SparseVectorPrefixSums(dense(df), "n", "rank", 0, ["l_linestatus"], 0.6)(df)


@query("""WITH p AS (SELECT l_returnflag AS f, least(greatest(l_extendedprice, 1000), 50000) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT f, x, sum(n) OVER (PARTITION BY f ORDER BY x) AS rank, sum(n) OVER (PARTITION BY f) AS total FROM p UNION ALL SELECT f, 1000, 0, sum(n) FROM p GROUP BY f),
i AS (SELECT f, x AS low, coalesce(lead(x) OVER (PARTITION BY f ORDER BY rank), 50000) AS high, rank, total FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY abs(rank - 0.25 * total), rank) AS k FROM i WHERE high > low)
SELECT f AS l_returnflag, low::DOUBLE AS low, high::DOUBLE AS high FROM r WHERE k = 1""")
def quantile_interval(spark, sf_dir):
    """The interval from which the first quartile is drawn, from values and their counts."""
    df = lines(spark, sf_dir, "l_returnflag", "l_extendedprice")
    value = grouped.clip(F.col("l_extendedprice"), 1000.0, 50000.0)
    counted = df.groupBy("l_returnflag", value.alias("__value")).agg(F.count("*").alias("__n"))
    found = quantiles.winning_intervals(counted, df.select("l_returnflag").distinct(), 0.25, 1000.0, 50000.0, INFINITY)
    return found.select("l_returnflag", F.col("__low").alias("low"), F.col("__high").alias("high"))


# -- noise


@query("SELECT o_orderkey, o_totalprice FROM orders")
def add_noise_to_column(spark, sf_dir):
    """Noise of scale 0 on one column."""
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    series = noise.AddNoiseToSeries(noise.AddLaplaceNoise(dense(df)["o_totalprice"].to_numpy_domain(), 0))
    return noise.AddNoiseToColumn(dense(df), series, "o_totalprice")(df)


@query("SELECT * FROM (VALUES ('laplace', true), ('geometric', true), ('discrete gaussian', true), ('gaussian', true)) t(kind, fits)")
def noise_distributions(spark, sf_dir):
    """Noise drawn by Spark's tasks, one value an order: mean and variance."""
    df = read_table(spark, sf_dir, "orders").select(F.lit(10).cast("long").alias("x"))
    g = math.exp(-1 / 3)
    kinds = {"laplace": (NoiseMechanism.LAPLACE, 3, 18.0), "geometric": (NoiseMechanism.GEOMETRIC, 3, 2 * g / (1 - g) ** 2), "discrete gaussian": (NoiseMechanism.DISCRETE_GAUSSIAN, 3, 9.0), "gaussian": (NoiseMechanism.GAUSSIAN, 3, 9.0)}
    found = []
    for kind, (mechanism, scale, variance) in kinds.items():
        r = df.select(noise.noisy(F.col("x"), mechanism, ExactNumber(scale)).alias("x")).agg(F.count("*"), F.avg("x"), F.var_pop("x")).first()
        found.append((kind, abs(r[1] - 10) < 6 * math.sqrt(variance / r[0]) and 0.5 < r[2] / variance < 2))
    return rows_of(spark, "kind string, fits boolean", found)


_DRAWS = {"laplace": 16, "geometric": 16, "discrete gaussian": 16, "gaussian": 16, "square root gaussian": 1, "exponential polylogarithmic": 1}


@query(f"SELECT law, (SELECT count(*) FROM lineitem) * times AS n, true AS fits, false AS fits_another_scale FROM (VALUES {', '.join(repr(x) for x in _DRAWS.items())}) t(law, times)")
def noise_laws(spark, sf_dir):
    """Noise drawn by Spark's tasks, some values a line: whether it has its law, by bins of exact mass, and whether a law of a scale that is 5 % (per-record noise: 60 %) larger is told apart.

    Either answer is wrong less often than once in some millions.
    """
    plain = lambda mechanism, scale: lambda n: noise.draw_many(mechanism, np.zeros(n, np.int64 if mechanism.integral else np.float64), ExactNumber(scale))
    kinds = {
        "laplace": (plain(NoiseMechanism.LAPLACE, 3), laws.laplace(3), laws.laplace(3.15)),
        "geometric": (plain(NoiseMechanism.GEOMETRIC, 40), laws.geometric(40), laws.geometric(42)),
        "discrete gaussian": (plain(NoiseMechanism.DISCRETE_GAUSSIAN, 40), laws.discrete_gaussian(1600), laws.discrete_gaussian(1764)),
        "gaussian": (plain(NoiseMechanism.GAUSSIAN, 3), laws.gaussian(3), laws.gaussian(3.15)),
        "square root gaussian": (lambda n: batches.square_root_gaussian(n, 2.0), laws.square_root_gaussian(2.0), laws.square_root_gaussian(3.2)),
        "exponential polylogarithmic": (lambda n: batches.exponential_polylogarithmic(n, 1.0, 1.0, 2.0), laws.exponential_polylogarithmic(1.0, 1.0, 2.0), laws.exponential_polylogarithmic(1.0, 1.0, 3.2)),
    }
    draws = [laws.Draws(draw, _DRAWS[kind], tuple(both)) for kind, (draw, *both) in kinds.items()]
    counted = laws.counts_of_draws(lines(spark, sf_dir, "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], draws)
    found = [(kind, sum(seen[0]), *(laws.statistic(n, law) <= laws.threshold(law) for n, law in zip(seen, both))) for (kind, (_, *both)), seen in zip(kinds.items(), counted)]
    return rows_of(spark, "law string, n long, fits boolean, fits_another_scale boolean", found)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS fourth_root, round(l_extendedprice, 2) AS square_root, round(l_extendedprice, 2) AS logarithm FROM lineitem")
def per_record_without_noise(spark, sf_dir):
    """Per-record mechanisms of scale 0 give their values back."""
    price = F.col("l_extendedprice")
    kinds = {"fourth_root": per_record.fourth_root_transformation(price, 10.0, 0.0), "square_root": per_record.square_root_transformation(price, 10.0, 0.0), "logarithm": per_record.log_transformation(price, 10.0, 0.0)}
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(k) for k, c in kinds.items()])


@query("SELECT l_returnflag, count(*) AS n, true AS roots_fit, true AS logarithms_fit FROM lineitem GROUP BY 1")
def per_record_noise(spark, sf_dir):
    """Noise of per-record mechanisms on prices of each flag: transformed back, it is normal."""
    price, sigma = F.col("l_extendedprice"), 0.5
    df = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = []
    with shared.keeping(spark):
        drawn = shared.get_materialized_df(df.select("l_returnflag", price, per_record.square_root_transformation(price, 0.0, sigma).alias("root"), per_record.log_transformation(price, 0.0, sigma).alias("log")))
        for (flag,) in sorted(drawn.select("l_returnflag").distinct().collect()):
            part = drawn.where(F.col("l_returnflag") == flag)
            away = F.sqrt("root") - F.sqrt(price), F.log("log") - F.log(price)
            found.append((flag, part.count(), *(laws.fits(part, a, laws.gaussian(sigma)) for a in away)))
    return rows_of(spark, "l_returnflag string, n long, roots_fit boolean, logarithms_fit boolean", found)


# -- distances


@query("SELECT count(*) FILTER (WHERE a > 0 OR b > 0) AS groups_changed, sum(a + b)::BIGINT AS rows_changed, sum((a + b) * (a + b))::BIGINT AS squared, sum(CASE WHEN a + b = 0 THEN 0 WHEN m = 0 OR n = 0 THEN 1 ELSE 2 END)::BIGINT AS groups_distance FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 = 0) AS a, 0 AS b, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS m FROM customer GROUP BY 1)")
def grouped_distances(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    less = df.where("c_custkey % 4 != 0")
    far = {k: IfGroupedBy("c_nationkey", m).distance(df, less, dense(df)) for k, m in (("sum", SumOf(SD)), ("root", RootSumOfSquared(SD)), ("groups", SD))}
    changed = df.where("c_custkey % 4 = 0").select("c_nationkey").distinct().count()
    whole = lambda x: int(x.to_fraction())
    return one_row(spark, groups_changed=changed, rows_changed=whole(far["sum"]), squared=whole(far["root"] * far["root"]), groups_distance=whole(far["groups"]))


@query("SELECT sum(abs(l_linenumber - l_orderkey % 3))::DOUBLE AS total, sqrt(sum((l_linenumber - l_orderkey % 3) ** 2)) AS root, sum(abs(l_linenumber - l_orderkey % 3))::DOUBLE AS of_columns FROM lineitem")
def column_distances(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    one, two = df.select(F.col("l_linenumber").cast("long").alias("x")), df.select((F.col("l_orderkey") % 3).cast("long").alias("x"))
    absolute = metrics.AbsoluteDifference()
    total, root = metrics.OnColumn("x", SumOf(absolute)), metrics.OnColumn("x", RootSumOfSquared(absolute))
    d = dense(one)
    both = metrics.OnColumns([total, root]).distance(one, two, d)
    return one_row(spark, total=float(total.distance(one, two, d).to_float(True)), root=float(root.distance(one, two, d).to_float(True)), of_columns=float(both[0].to_float(True)))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS o, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS c, 7 AS numbers")
def dict_distances(spark, sf_dir):
    data, domain, metric = _pair(spark, sf_dir)
    less = {"o": data["o"].where("o_orderkey % 3 != 0"), "c": data["c"].where("c_custkey % 5 != 0")}
    far = metric.distance(data, less, domain)
    numbers = metrics.AbsoluteDifference().distance(np.int64(3), np.int64(10), NumpyIntegerDomain())
    return one_row(spark, **{k: int(v.to_fraction()) for k, v in far.items()}, numbers=int(numbers.to_fraction()))


# -- interactive queries


_INTERACTIVE = "SELECT 'sequential' AS way, count(*) FILTER (WHERE l_quantity > 10) AS n FROM lineitem UNION ALL SELECT 'adaptive', count(*) FROM lineitem UNION ALL SELECT 'answer', count(*) FROM lineitem UNION ALL SELECT 'decorated', 2 * count(*) FROM lineitem UNION ALL SELECT 'parallel ' || l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'once', count(*) FROM lineitem"


@query(_INTERACTIVE)
def queryables(spark, sf_dir):
    df = lines(spark, sf_dir, "l_quantity", "l_returnflag")
    d = dense(df)
    count = releases.create_count_measurement(d, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC)
    asked = interactive.MakeInteractive(count)
    found = []
    budget = interactive.SequentialComposition(d, SD, PureDP(), 1, INFINITY)(df)
    budget(interactive.TransformationQuery(rows.Filter(d, SD, "l_quantity > 10")))
    found.append(("sequential", budget(interactive.MeasurementQuery(asked))(None)))
    found.append(("adaptive", interactive.create_adaptive_composition(d, SD, 1, INFINITY, PureDP())(df)(interactive.MeasurementQuery(count))))
    found.append(("answer", interactive.GetAnswerQueryable(count, df)(None)))
    found.append(("decorated", interactive.DecorateQueryable(asked, lambda q: q, lambda a: 2 * a)(df)(None)))
    flags = [r[0] for r in df.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    parts = rows.PartitionByKeys(d, SD, False, ["l_returnflag"], [(k,) for k in flags])
    parallel = interactive.RetirableQueryable(interactive.ParallelComposition(parts.output_domain, parts.output_metric, PureDP(), [asked] * len(flags))(parts(df)))
    for i, k in enumerate(flags):
        found.append((f"parallel {k}", parallel(interactive.IndexQuery(i))(None)))
    parallel(interactive.RetireQuery())
    found.append(("once", core.NonInteractivePostProcess(asked, lambda q: q(None))(df)))
    return rows_of(spark, "way string, n long", [(k, int(v)) for k, v in found])


@query("SELECT count(*) AS n, count(*) AS unwrapped FROM orders")
def identities(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    d = dense(df)
    unwrapped = core.UnwrapIfGroupedBy(d, IfGroupedBy("o_custkey", SumOf(SD)))
    return one_row(spark, n=core.Identity(SD, d)(df).count(), unwrapped=unwrapped(df).count())


# -- domains, numbers, tables of a session


@query("""SELECT 'materialised' AS what, count(*) AS n, sum(l_quantity) AS total FROM lineitem UNION ALL SELECT 'named', count(*), sum(l_quantity) FROM lineitem UNION ALL SELECT 'sanitized', count(*), sum(l_quantity) FROM lineitem
UNION ALL SELECT * FROM (VALUES ('files with three tables and more', 1, 0.0), ('files after', 0, 0.0), ('databases left', 0, 0.0)) t(what, n, total)""")
def session_tables(spark, sf_dir):
    """Tables that are written once, what they hold, and that no file of them is left afterwards."""
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    sums = lambda t: tuple(t.agg(F.count("*"), F.sum("l_quantity")).first())
    with shared.keeping(spark) as folder:
        before = shared.files_under(spark, folder)
        written = {"materialised": shared.get_materialized_df(df), "named": shared.get_materialized_df(df, f"lines_{id(df)}"), "sanitized": shared.sanitized(df)}
        found = [(name, *sums(t)) for name, t in written.items()]
        found.append(("files with three tables and more", int(shared.files_under(spark, folder) - before >= 2), 0.0))
    found.append(("files after", shared.files_under(spark, folder) - before, 0.0))
    spark.sql(f"DROP DATABASE {shared.Config.temp_db_name()} CASCADE")
    found.append(("databases left", sum(b.name == shared.Config.temp_db_name() for b in spark.catalog.listDatabases()), 0.0))
    return rows_of(spark, "what string, n long, total double", found)


@query("SELECT * FROM (VALUES ('OutOfDomainError'), ('DomainMismatchError'), ('UnsupportedDomainError'), ('DomainColumnError'), ('UnsupportedMetricError'), ('MetricMismatchError'), ('UnsupportedCombinationError'), ('UnsupportedMeasureError'), ('MeasureMismatchError'), ('UnsupportedNoiseMechanismError'), ('InsufficientBudgetError'), ('DomainKeyError'), ('InactiveAccountantError')) t(error)")
def refusals(spark, sf_dir):
    """What the library refuses, by the errors it raises."""
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    d, other = dense(df), SparkDataFrameDomain({"x": SparkStringColumnDescriptor()})
    count = lambda domain, measure=PureDP(): releases.create_count_measurement(domain, SD, measure, 1, NoiseMechanism.GEOMETRIC)

    def retired():
        a = interactive.PrivacyAccountant.launch(interactive.SequentialComposition(d, SD, PureDP(), 1, 1), df)
        a.retire()
        a.measure(count(d))

    tries = [
        lambda: d.validate(df.withColumnRenamed("o_orderstatus", "z")), lambda: core.Composition([count(d), count(other)]), lambda: grouped.create_count_aggregation(d, SD) and grouped.CountGrouped(d, SumOf(SD)), lambda: releases.create_sum_measurement(d, SD, PureDP(), 1, NoiseMechanism.LAPLACE, "o_orderstatus", 0, 1),
        lambda: tables.Subset(DictDomain({"a": d}), SD, ["a"]), lambda: core.ChainTT(core.Identity(SD, d), core.Identity(HammingDistance(), d)), lambda: releases.create_count_measurement(d, SD, ApproxDP(), (1, "1/2"), NoiseMechanism.GEOMETRIC), lambda: core.PureDPToRhoZCDP(fixed_loss(RhoZCDP(), 1)),
        lambda: core.Composition([count(d), count(d, RhoZCDP())]), lambda: releases.create_count_measurement(d, SD, PureDP(), 1, NoiseMechanism.DISCRETE_GAUSSIAN), lambda: measures.PureDPBudget(1).subtract(2), lambda: tables.GetValue(DictDomain({"a": d}), DictMetric({"a": SD}), "b"), retired,
    ]
    found = Counter()
    for attempt in tries:
        try:
            attempt()
        except Exception as e:  # the kinds of errors are what is shown
            found[type(e).__name__] += 1
    return rows_of(spark, "error string", [(k,) for k in found])


# -- releases with noise: whether they lie as near to the exact answers as their noise says


def _near_query(name: str, create, exact, reach, budget=8, **arguments) -> None:
    """All flags with a noisy answer, and whether it is within ``reach``, a number or SQL of the group, which it misses less often than once in some millions."""

    def run(spark, sf_dir):
        df = lines(spark, sf_dir, "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
        domain = dense(df)
        keys = grouped.create_groupby_from_list_of_keys(domain, SD, False, ["l_returnflag"], [("A",), ("N",), ("R",)])
        found = create(domain, SD, PureDP(), budget, groupby_transformation=keys, **arguments)(df)
        column = [c for c in found.columns if c != "l_returnflag"][0]
        return found.join(df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.expr(exact).alias("exact__"), F.expr(str(reach)).alias("reach__")), "l_returnflag").select("l_returnflag", "n", (F.abs(F.col(f"`{column}`") - F.col("exact__")) <= F.col("reach__")).alias("near"))

    run.__name__ = name
    query("SELECT l_returnflag, count(*) AS n, true AS near FROM lineitem GROUP BY 1")(run)


_clipped = "least(greatest(l_quantity, 5), 40)"
#: Three numbers of scales 17.5 / 8, 306.25 / 8 and 1 / 8 about the middle, each within 20 scales: (766 + 2 * 17.5 * 44 + 306 * 2.5) / n, and a sample's n - 1.
_VARIANCE = "4000 / count(*)"
_near_query("noisy_sum", releases.create_sum_measurement, f"sum({_clipped})", 40 * 20 / 8, noise_mechanism=NoiseMechanism.LAPLACE, measure_column="l_quantity", lower=5, upper=40)
_near_query("noisy_count_distinct", releases.create_count_distinct_measurement, "count(DISTINCT l_linenumber, l_quantity, l_extendedprice)", 20 / 8, 8, noise_mechanism=NoiseMechanism.GEOMETRIC)
_near_query("noisy_variance", releases.create_variance_measurement, f"var_samp({_clipped})", _VARIANCE, 24, noise_mechanism=NoiseMechanism.LAPLACE, measure_column="l_quantity", lower=5, upper=40)
_near_query("noisy_standard_deviation", releases.create_standard_deviation_measurement, f"stddev_samp({_clipped})", f"{_VARIANCE} / 20", 24, noise_mechanism=NoiseMechanism.LAPLACE, measure_column="l_quantity", lower=5, upper=40)
_near_query("noisy_quantile", releases.create_quantile_measurement, "percentile_approx(l_extendedprice, 0.5, 10000)", 4000.0, 8, measure_column="l_extendedprice", quantile=0.5, lower=0, upper=200000)


@query("SELECT f AS l_returnflag, true AS near FROM (VALUES ('A'), ('N'), ('R')) k(f)")
def noisy_bounds(spark, sf_dir):
    """Noisy bounds are powers of two between half and four times what holds nine tenths of the values."""
    df = lines(spark, sf_dir, "l_returnflag", "l_partkey")
    domain = dense(df)
    keys = grouped.create_groupby_from_list_of_keys(domain, SD, False, ["l_returnflag"], [("A",), ("N",), ("R",)])
    found = releases.create_bounds_measurement(domain, SD, PureDP(), 8, "l_partkey", 0.9, groupby_transformation=keys, lower_bound_column="low", upper_bound_column="high")(df)
    exact = df.groupBy("l_returnflag").agg(F.percentile_approx(F.abs("l_partkey"), 0.9, 1000).alias("most"))
    return found.join(exact, "l_returnflag").select("l_returnflag", ((F.col("low") == -F.col("high")) & F.col("high").between(F.col("most") / 2, F.col("most") * 4)).alias("near"))
