"""Queries over the driver's tables, one for each operator, with their SQL.

All are without noise (an infinite budget), where every operator but the quantile
is deterministic; three noisy ones at the end have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.operators import grouped, joins, maps, releases, rows, tables, truncation
from quietframe.operators.noise import NoiseMechanism
from quietframe.plans.core import Composition, HammingDistanceToSymmetricDifference, Measurement, PostProcess
from quietframe.plans.domains import DictDomain, ListDomain, NumpyIntegerDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor, SparkIntegerColumnDescriptor, SparkRowDomain, SparkStringColumnDescriptor, convert_spark_schema
from quietframe.plans.interactive import PrivacyAccountant, SequentialComposition
from quietframe.plans.measures import PureDP, RhoZCDP
from quietframe.plans.metrics import AbsoluteDifference, AddRemoveKeys, DictMetric, HammingDistance, IfGroupedBy, RootSumOfSquared, SumOf, SymmetricDifference
from quietframe.sources.shared import read_table

SD = SymmetricDifference()
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def fixed_loss(measure, loss):
    """A measurement of a given loss at distance 1, linear in the distance."""

    class Fixed(Measurement):
        def privacy_function(self, d_in):
            return ExactNumber(d_in) * ExactNumber(loss)

    return Fixed(NumpyIntegerDomain(), AbsoluteDifference(), measure)


def dense(df: DataFrame, *nullable: str) -> SparkDataFrameDomain:
    """The domain of a table without nulls, NaNs and infinities but in the named columns."""
    schema = StructType([f for f in df.schema])
    for f in schema:
        f.nullable = f.name in nullable
    out = {}
    for c, d in convert_spark_schema(schema).items():
        out[c] = SparkFloatColumnDescriptor(c in nullable, c in nullable, c in nullable, d.size) if isinstance(d, SparkFloatColumnDescriptor) else d
    return SparkDataFrameDomain(out)


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = read_table(spark, sf_dir, "lineitem")
    return df.select(*columns) if columns else df


def one_row(spark: SparkSession, **values: Any) -> DataFrame:
    return spark.createDataFrame([Row(**{k: v.item() if hasattr(v, "item") else v for k, v in values.items()})])


# -- rows


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def filter(spark, sf_dir):  # noqa: A001
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rows.Filter(dense(df), SD, "l_quantity >= 45 AND l_returnflag = 'R'")(df)


@query("SELECT l_returnflag, l_orderkey FROM lineitem")
def select(spark, sf_dir):
    df = lines(spark, sf_dir)
    return rows.Select(dense(df), SD, ["l_returnflag", "l_orderkey"])(df)


@query("SELECT l_orderkey AS key, l_returnflag AS flag, l_linenumber FROM lineitem")
def rename(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_returnflag", "l_linenumber")
    return rows.Rename(dense(df), SD, {"l_orderkey": "key", "l_returnflag": "flag"})(df)


_SPECIAL = """CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE WHEN l_linenumber = 3 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 4 THEN '-Infinity'::DOUBLE ELSE l_quantity END"""


def special(spark, sf_dir) -> tuple[DataFrame, SparkDataFrameDomain]:
    n = F.col("l_linenumber")
    value = F.when(n == 1, F.lit(None)).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(float("inf"))).when(n == 4, F.lit(float("-inf"))).otherwise(F.col("l_quantity")).cast("double")
    df = lines(spark, sf_dir).select("l_orderkey", n, value.alias("v"))
    return df, dense(df, "v")


def as_text(df: DataFrame) -> DataFrame:
    """The special values as text."""
    v = F.col("v")
    text = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return df.select("l_orderkey", "l_linenumber", text.otherwise(F.when(~F.isnan(v) & (F.abs(v) < 1e9), v).otherwise(F.lit(0.0)).cast("long").cast("string")).alias("v"))


def _special_query(name: str, operator, argument, where: str = "TRUE", value: str | None = None):
    kind = f"SELECT l_orderkey, l_linenumber, v FROM (SELECT l_orderkey, l_linenumber, {_SPECIAL} AS v FROM lineitem)"
    shown = "CASE WHEN v IS NULL THEN 'null' WHEN isnan(v) THEN 'nan' WHEN v = 'Infinity'::DOUBLE THEN 'inf' WHEN v = '-Infinity'::DOUBLE THEN '-inf' ELSE v::BIGINT::VARCHAR END AS v"
    sql = f"SELECT l_orderkey, l_linenumber, {shown} FROM (SELECT l_orderkey, l_linenumber, {value or 'v'} AS v FROM ({kind}) WHERE {where})"

    def run(spark, sf_dir):
        df, domain = special(spark, sf_dir)
        return as_text(operator(domain, SD, argument)(df))

    run.__name__ = name
    query(sql)(run)


_special_query("drop_nulls", rows.DropNulls, ["v"], "v IS NOT NULL")
_special_query("drop_nans", rows.DropNaNs, ["v"], "v IS NULL OR NOT isnan(v)")
_special_query("drop_infs", rows.DropInfs, ["v"], "v IS NULL OR NOT isinf(v)")
_special_query("replace_nulls", rows.ReplaceNulls, {"v": -1.0}, value="coalesce(v, -1)")
_special_query("replace_nans", rows.ReplaceNaNs, {"v": -2.0}, value="CASE WHEN isnan(v) THEN -2 ELSE v END")
_special_query("replace_infs", rows.ReplaceInfs, {"v": (-3.0, 3.0)}, value="CASE WHEN v = 'Infinity'::DOUBLE THEN 3 WHEN v = '-Infinity'::DOUBLE THEN -3 ELSE v END")


@query("""SELECT l_returnflag, l_linenumber, hex(to_json([l_returnflag, l_linenumber::VARCHAR, (row_number() OVER (PARTITION BY l_returnflag, l_linenumber))::VARCHAR])::VARCHAR) AS id FROM lineitem""")
def unique_id(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linenumber")
    return rows.AddUniqueColumn(dense(df), "id")(df)


@query("SELECT event_type, count(*) AS n, sum(value) >= 0 AS positive FROM events GROUP BY 1")
def partition_by_keys(spark, sf_dir):
    df = read_table(spark, sf_dir, "events").select("event_type", "value", "user_id")
    kinds = [r[0] for r in df.select("event_type").distinct().orderBy("event_type").collect()]
    parts = rows.PartitionByKeys(dense(df), SD, False, ["event_type"], [(k,) for k in kinds])(df)
    counted = [p.groupBy("event_type").agg(F.count("*").alias("n"), (F.sum("value") >= 0).alias("positive")) for p in parts]
    return reduce(DataFrame.unionByName, counted)


@query("SELECT count(*) AS n FROM lineitem")
def persist_action(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_returnflag")
    d = dense(df)
    kept = (rows.Persist(d, SD) | rows.SparkAction(d, SD) | rows.Unpersist(d, SD))(df)
    return kept.agg(F.count("*").alias("n"))


# -- user functions


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) > 50000 AS large, l_quantity + 1 AS more FROM lineitem")
def map_expr(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    source = dense(df).schema
    target = {c: source[c] for c in ("l_orderkey", "l_linenumber")} | {"large": SparkIntegerColumnDescriptor(), "more": SparkFloatColumnDescriptor()}
    f = maps.RowToRowTransformation(SparkRowDomain(source), SparkRowDomain(target), {"large": (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 50000).cast("long"), "more": F.col("l_quantity") + 1})
    return maps.Map(SD, f)(df).withColumn("large", F.col("large") == 1)


@query("SELECT l_orderkey, l_linenumber, lower(l_returnflag) || '!' AS low FROM lineitem")
def map_rows(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_returnflag")
    source = dense(df).schema
    target = {c: source[c] for c in ("l_orderkey", "l_linenumber")} | {"low": SparkStringColumnDescriptor()}
    f = maps.RowToRowTransformation(SparkRowDomain(source), SparkRowDomain(target), lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "low": r.l_returnflag.lower() + "!"})
    return maps.Map(SD, f)(df)


def _pairs(df: DataFrame, function, augment: bool = True):
    source = dense(df).schema
    target = (dict(source) if augment else {}) | {"part": SparkIntegerColumnDescriptor()}
    return maps.RowToRowsTransformation(SparkRowDomain(source), ListDomain(SparkRowDomain(target)), function, augment)


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, least(l_linenumber, 3) + 1))::BIGINT AS part FROM lineitem")
def flat_map(spark, sf_dir):
    df = lines(spark, sf_dir, "l_orderkey", "l_linenumber")
    parts = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.struct(i.cast("long").alias("part")))
    return maps.FlatMap(SD, _pairs(df, parts), 3)(df)


@query("SELECT c_custkey, unnest([c_custkey % 3, c_custkey % 5])::BIGINT AS part FROM customer")
def flat_map_rows(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").select("c_custkey")
    return maps.FlatMap(SD, _pairs(df, lambda r: [{"part": r.c_custkey % 3}, {"part": r.c_custkey % 5}, {"part": 0}]), 2)(df)


@query("SELECT DISTINCT * FROM (SELECT c_custkey, unnest([c_custkey % 3, c_custkey % 5])::BIGINT AS part FROM customer)")
def grouping_flat_map(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").select("c_custkey")
    array = F.array(F.struct((F.col("c_custkey") % 3).alias("part")), F.struct((F.col("c_custkey") % 5).alias("part")), F.struct(F.lit(77).cast("long").alias("part")))
    return maps.GroupingFlatMap(SumOf(SD), _pairs(df, array), 2)(df)


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) > 500000 AS much FROM orders GROUP BY 1")
def flat_map_by_key(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    source = dense(df).schema
    target = {"n": SparkIntegerColumnDescriptor(), "much": SparkIntegerColumnDescriptor()}
    f = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(source)), ListDomain(SparkRowDomain(target)), lambda rs: [{"n": len(rs), "much": int(sum(r.o_totalprice for r in rs) > 500000)}])
    return maps.FlatMapByKey(IfGroupedBy("o_custkey", SD), f)(df).withColumn("much", F.col("much") == 1)


# -- joins


def customers(spark, sf_dir) -> DataFrame:
    """Customers, some of a nation that the public table does not have."""
    key = F.when(F.col("c_custkey") % 9 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", key.alias("nationkey"))


def nations(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")


_CUSTOMERS = "(SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS nationkey FROM customer)"


@query(f"SELECT nationkey, c_custkey, n_name FROM {_CUSTOMERS} JOIN nation ON nationkey = n_nationkey")
def public_join_inner(spark, sf_dir):
    df, public = customers(spark, sf_dir), nations(spark, sf_dir)
    return joins.PublicJoin(dense(df), SD, public)(df)


@query(f"SELECT nationkey, c_custkey, n_name FROM {_CUSTOMERS} LEFT JOIN nation ON nationkey = n_nationkey")
def public_join_left(spark, sf_dir):
    df, public = customers(spark, sf_dir), nations(spark, sf_dir)
    return joins.PublicJoin(dense(df), SD, public, how="left")(df)


_LEFT = "(SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS k, o_orderkey AS v FROM orders)"
_RIGHT = "(SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS k, c_acctbal::BIGINT AS v FROM customer)"


def _sides(spark, sf_dir):
    """Whole tables, with null keys and keys without a match on both sides."""
    order, customer = F.col("o_orderkey"), F.col("c_custkey")
    left = read_table(spark, sf_dir, "orders").select(F.when(order % 97 == 0, F.lit(None)).when(order % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"), order.alias("v"))
    right = read_table(spark, sf_dir, "customer").select(F.when(customer % 50 == 0, F.lit(None)).when(customer % 13 == 0, customer + 1000000000).otherwise(customer).alias("k"), F.round("c_acctbal").cast("long").alias("v"))
    return left, right


def _join_query(name: str, how: str, sql_how: str, nulls: bool = False):
    on = "l.k IS NOT DISTINCT FROM r.k" if nulls else "l.k = r.k"
    columns = "l.k, l.v" if how == "left_anti" else "coalesce(l.k, r.k) AS k, l.v AS v_left, r.v AS v_right"
    right = _RIGHT.replace("c_acctbal::BIGINT", "(sign(c_acctbal) * floor(abs(c_acctbal) + 0.5))::BIGINT")

    def run(spark, sf_dir):
        left, other = _sides(spark, sf_dir)
        return joins.join(left, other, ["k"], how, nulls)

    run.__name__ = name
    query(f"SELECT {columns} FROM {_LEFT} l {sql_how} JOIN {right} r ON {on}")(run)


_join_query("join_inner", "inner", "INNER")
_join_query("join_left", "left", "LEFT")
_join_query("join_right", "right", "RIGHT")
_join_query("join_outer", "outer", "FULL")
_join_query("join_anti", "left_anti", "ANTI")
_join_query("join_nulls_equal", "inner", "INNER", True)


def hashed(columns: list[str], texts: set[str] = frozenset(), more: str = "") -> str:
    """The order of rows in SQL: SHA-256 of the cells' SHA-256, twice."""
    cells = [f"sha256({c})" if c in texts else f"sha256(bin({c}))" for c in columns] + ([f"sha256(bin({more}))"] if more else [])
    return f"sha256(sha256(concat_ws(',', {', '.join(cells)})))"


def truncated(table: str, columns: list[str], group: str, k: int, texts: set[str] = frozenset()) -> str:
    every = ", ".join(columns)
    numbered = f"SELECT {every}, row_number() OVER (PARTITION BY {every} ORDER BY {every}) AS number_ FROM {table}"
    placed = f"SELECT {every}, row_number() OVER (PARTITION BY {group} ORDER BY {hashed(columns, texts, 'number_')}, {every}) AS place_ FROM ({numbered})"
    return f"SELECT {every} FROM ({placed}) WHERE place_ <= {k}"


def _private(spark, sf_dir, strategy) -> DataFrame:
    left = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    domain = DictDomain({"l": dense(left), "r": dense(right)})
    return joins.PrivateJoin(domain, "l", "r", strategy, strategy, 8, 60)({"l": left, "r": right})


@query(f"SELECT l.k, l.o_orderkey, r.event_id FROM ({truncated('(SELECT o_custkey AS k, o_orderkey FROM orders)', ['k', 'o_orderkey'], 'k', 8)}) l JOIN ({truncated('(SELECT user_id AS k, event_id FROM events)', ['k', 'event_id'], 'k', 60)}) r ON l.k = r.k")
def private_join_truncate(spark, sf_dir):
    return _private(spark, sf_dir, joins.TruncationStrategy.TRUNCATE)


@query("SELECT l.k, l.o_orderkey, r.event_id FROM (SELECT o_custkey AS k, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) <= 8) l JOIN (SELECT user_id AS k, event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) <= 60) r ON l.k = r.k")
def private_join_drop(spark, sf_dir):
    return _private(spark, sf_dir, joins.TruncationStrategy.DROP)


def _dictionary(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    data = {"orders": orders, "customer": customer}
    return data, DictDomain({k: dense(v) for k, v in data.items()}), AddRemoveKeys(dict.fromkeys(data, "custkey"))


@query("SELECT o_custkey AS custkey, o_orderkey, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def private_join_on_key(spark, sf_dir):
    data, domain, metric = _dictionary(spark, sf_dir)
    return joins.PrivateJoinOnKey(domain, metric, "orders", "customer", "both")(data)["both"]


# -- limits


@query(truncated("lineitem", ["l_suppkey", "l_orderkey", "l_returnflag"], "l_suppkey", 20, {"l_returnflag"}))
def limit_rows_per_group(spark, sf_dir):
    df = lines(spark, sf_dir, "l_suppkey", "l_orderkey", "l_returnflag")
    return truncation.LimitRowsPerGroup(dense(df), SD, "l_suppkey", 20)(df)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) <= 12")
def drop_large_groups(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return truncation.drop_large_groups(df, ["o_custkey"], 12)


@query(f"SELECT user_id, event_type, event_id FROM events WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY {hashed(['user_id', 'event_type'], {'event_type'})}, event_type) AS place FROM (SELECT DISTINCT user_id, event_type FROM events)) WHERE place <= 2)")
def limit_keys_per_group(spark, sf_dir):
    df = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return truncation.LimitKeysPerGroup(dense(df), IfGroupedBy("user_id", SD), "user_id", "event_type", 2)(df)


@query(truncated("events", ["user_id", "event_type", "event_id"], "user_id, event_type", 3, {"event_type"}))
def limit_rows_per_key_per_group(spark, sf_dir):
    df = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return truncation.LimitRowsPerKeyPerGroup(dense(df), IfGroupedBy("user_id", SD), "user_id", "event_type", 3)(df)


# -- aggregates without noise

_KEYS = "(SELECT f AS l_returnflag, s AS l_linestatus FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(f), (VALUES ('F'), ('O')) b(s))"


def _groups(df: DataFrame, domain: SparkDataFrameDomain, use_l2: bool = False):
    return grouped.create_groupby_from_column_domains(domain, SD, use_l2, {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"]})


def _grouped(create, measure: bool = True, **arguments):
    def run(spark, sf_dir):
        df = lines(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
        df = df.select("l_returnflag", "l_linestatus", "l_quantity", F.col("l_linenumber").cast("long").alias("l_linenumber"))
        domain = dense(df)
        return create(domain, SD, PureDP(), INFINITY, NoiseMechanism.LAPLACE if measure else NoiseMechanism.GEOMETRIC, groupby_transformation=_groups(df, domain), **arguments)(df)

    return run


def _total(create, name: str, noise: NoiseMechanism = NoiseMechanism.LAPLACE, **arguments):
    def run(spark, sf_dir):
        df = lines(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity")
        return one_row(spark, **{name: create(dense(df), SD, PureDP(), INFINITY, noise, **arguments)(df)})

    return run


def over_keys(aggregate: str, empty: str, name: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, CASE WHEN n IS NULL THEN {empty} ELSE x END AS {name} FROM {_KEYS} k LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n, {aggregate} AS x FROM lineitem GROUP BY 1, 2) USING (l_returnflag, l_linestatus)"


@query(f"SELECT l_returnflag, l_linestatus, coalesce(n, 0) AS count FROM {_KEYS} k LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2) USING (l_returnflag, l_linestatus)")
def count_grouped(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity")
    domain = dense(df)
    measure = releases.create_count_measurement(domain, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC, groupby_transformation=_groups(df, domain))
    return (rows.Filter(domain, SD, "l_quantity >= 10") | measure)(df)


def _rounded(run, name: str, digits: int = 4):
    def rounded(spark, sf_dir):
        out = run(spark, sf_dir)
        return out.withColumn(name, F.when(F.isnan(name), F.lit(None)).otherwise(F.round(name, digits)))

    return rounded


def _add(name: str, sql: str, run) -> None:
    run.__name__ = name
    query(sql)(run)


_CLIPPED = "least(greatest(l_quantity, 5), 40)"
_VARIANCE = f"greatest(least(var_samp({_CLIPPED}), 306.25), 0)"
_add("count", "SELECT count(*) AS n FROM lineitem", _total(releases.create_count_measurement, "n", NoiseMechanism.GEOMETRIC))
_add("count_distinct", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)", _total(releases.create_count_distinct_measurement, "n", NoiseMechanism.GEOMETRIC))
_add("sum", f"SELECT sum({_CLIPPED}) AS total FROM lineitem", _total(releases.create_sum_measurement, "total", measure_column="l_quantity", lower=5, upper=40))
_add("average", f"SELECT round(avg({_CLIPPED}), 4) AS mean FROM lineitem", _rounded(_total(releases.create_average_measurement, "mean", measure_column="l_quantity", lower=5, upper=40), "mean"))
_add("variance", f"SELECT round({_VARIANCE}, 4) AS var FROM lineitem", _rounded(_total(releases.create_variance_measurement, "var", measure_column="l_quantity", lower=5, upper=40), "var"))
_add("standard_deviation", f"SELECT round(sqrt({_VARIANCE}), 4) AS std FROM lineitem", _rounded(_total(releases.create_standard_deviation_measurement, "std", measure_column="l_quantity", lower=5, upper=40), "std"))
_add("count_distinct_grouped", over_keys("count(DISTINCT (l_quantity, l_linenumber))", "0", "n"), _grouped(releases.create_count_distinct_measurement, False, count_column="n"))
_add("sum_grouped", over_keys(f"sum({_CLIPPED})", "0", "total"), _grouped(releases.create_sum_measurement, measure_column="l_quantity", lower=5, upper=40, sum_column="total"))
_add("sum_grouped_integers", over_keys("sum(least(l_linenumber, 4))::BIGINT", "0", "total"), _grouped(releases.create_sum_measurement, False, measure_column="l_linenumber", lower=0, upper=4, sum_column="total"))
_add("average_grouped", over_keys(f"round(avg({_CLIPPED}), 4)", "22.5", "mean"), _rounded(_grouped(releases.create_average_measurement, measure_column="l_quantity", lower=5, upper=40, average_column="mean"), "mean"))
_add("variance_grouped", over_keys(f"round({_VARIANCE}, 4)", "NULL", "var"), _rounded(_grouped(releases.create_variance_measurement, measure_column="l_quantity", lower=5, upper=40, variance_column="var"), "var"))
_add("standard_deviation_grouped", over_keys(f"round(sqrt({_VARIANCE}), 4)", "NULL", "std"), _rounded(_grouped(releases.create_standard_deviation_measurement, measure_column="l_quantity", lower=5, upper=40, standard_deviation_column="std"), "std"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS count FROM customer GROUP BY 1, 2")
def partition_selection(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    return releases.create_partition_selection_measurement(dense(df), INFINITY, "1/10")(df)


_BUCKETS = "SELECT l_returnflag, CASE WHEN abs(l_partkey) <= 1 THEN 0 ELSE length(bin(abs(l_partkey) - 1)) END AS r FROM lineitem"


@query(f"""WITH b AS ({_BUCKETS}), c AS (SELECT f AS l_returnflag, g AS r, (SELECT count(*) FROM b WHERE b.l_returnflag = f AND b.r <= g) AS upto, (SELECT count(*) FROM b WHERE b.l_returnflag = f) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) k(f), range(0, 63) t(g)),
p AS (SELECT l_returnflag, min(r) AS r FROM c WHERE upto >= (n * 0.9::DOUBLE)::DOUBLE - (n * 0.9::DOUBLE) % 1 GROUP BY 1) SELECT l_returnflag, -(2 ** r)::BIGINT AS low, (2 ** r)::BIGINT AS high FROM p""")
def bounds(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_partkey")
    domain = dense(df)
    keys = grouped.create_groupby_from_list_of_keys(domain, SD, False, ["l_returnflag"], [("A",), ("N",), ("R",), ("X",)])
    return releases.create_bounds_measurement(domain, SD, PureDP(), INFINITY, "l_partkey", 0.9, groupby_transformation=keys, lower_bound_column="low", upper_bound_column="high")(df)


@query("SELECT l_returnflag, true AS inside FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def quantile(spark, sf_dir):
    """The median without noise is a uniform point between the middle values, so the query tells whether it is."""
    df = lines(spark, sf_dir, "l_returnflag", "l_extendedprice")
    domain = dense(df)
    keys = grouped.create_groupby_from_list_of_keys(domain, SD, False, ["l_returnflag"], [("A",), ("N",), ("R",)])
    found = releases.create_quantile_measurement(domain, SD, PureDP(), INFINITY, "l_extendedprice", 0.5, 0, 200000, groupby_transformation=keys, quantile_column="q")(df)
    ranked = df.join(found, "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("q")).cast("double")).alias("share"))
    return ranked.select("l_returnflag", (F.abs(F.col("share") - 0.5) < 0.002).alias("inside"))


# -- distances, dictionaries, combinators, accountants


@query("SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber >= 3)) + (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber >= 3 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber <= 3)) AS symmetric, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT c_nationkey + c_custkey % 2 FROM customer)) AS hamming")
def distances(spark, sf_dir):
    df = lines(spark, sf_dir, "l_suppkey", "l_linenumber")
    one, two = (df.where(c).select("l_suppkey") for c in ("l_linenumber <= 3", "l_linenumber >= 3"))
    customer = read_table(spark, sf_dir, "customer")
    old, new = customer.select(F.col("c_nationkey").cast("long").alias("k")), customer.select((F.col("c_nationkey") + F.col("c_custkey") % 2).alias("k"))
    d = SymmetricDifference().distance(one, two, dense(one))
    h = HammingDistance().distance(old, new, dense(old))
    return one_row(spark, symmetric=int(d.to_fraction()), hamming=int(h.to_fraction()))


@query("SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) + 2 * count(*) FILTER (WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0) AS distance FROM customer")
def add_remove_keys_distance(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    changed = customer.where("k % 5 != 0").select("k", F.when(F.col("k") % 7 == 0, F.lit(99)).otherwise(F.col("n")).alias("n"))
    domain = DictDomain({"t": dense(customer)})
    return one_row(spark, distance=int(AddRemoveKeys({"t": "k"}).distance({"t": customer}, {"t": changed}, domain).to_fraction()))


@query("SELECT sum(n * n) AS squared FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 4 = 0 GROUP BY c_nationkey)")
def grouped_distance(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    less = customer.where("c_custkey % 4 != 0")
    d = IfGroupedBy("c_nationkey", RootSumOfSquared(SD)).distance(customer, less, dense(customer))
    return one_row(spark, squared=int((d * d).to_fraction()))


@query(f"SELECT custkey, o_orderkey, status FROM (SELECT o_custkey AS custkey, o_orderkey, o_orderstatus AS status FROM ({truncated('(SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)', ['o_custkey', 'o_orderkey', 'o_orderstatus'], 'o_custkey', 3, {'o_orderstatus'})}))")
def dict_values(spark, sf_dir):
    data, domain, metric = _dictionary(spark, sf_dir)
    one = tables.FilterValue(domain, metric, "orders", "even", "o_orderkey % 2 = 0")
    two = tables.LimitRowsPerGroupValue(one.output_domain, one.output_metric, "even", "few", 3)
    three = tables.RenameValue(two.output_domain, two.output_metric, "few", "named", {"o_orderstatus": "status"})
    get = tables.GetValue(three.output_domain, three.output_metric, "named")
    return tables.chain(one, two, three, get)(data)


@query("SELECT 'N' AS part, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'R', count(*) FROM region")
def dict_transform(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    domain, metric = DictDomain({"n": dense(nation), "r": dense(region)}), DictMetric({"n": SD, "r": SD})
    changed = tables.create_transform_value(domain, metric, "n", rows.Filter(dense(nation), SD, "n_regionkey = 1"), lambda d_in, d_out: d_in)
    final = changed | tables.create_rename(changed.output_domain, changed.output_metric, "r", "regions")
    out = final({"n": nation, "r": region})
    counted = [out[k].agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, k in (("N", "n"), ("R", "regions"))]
    return counted[0].unionByName(counted[1])


@query("SELECT count(*) AS n, sum(least(l_quantity, 30)) AS total, count(*) * 2 AS twice FROM lineitem")
def composition(spark, sf_dir):
    df = lines(spark, sf_dir, "l_quantity")
    domain = dense(df)
    n = releases.create_count_measurement(domain, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC)
    total = releases.create_sum_measurement(domain, SD, PureDP(), INFINITY, NoiseMechanism.LAPLACE, "l_quantity", 0, 30)
    answers = Composition([n, total, PostProcess(n, lambda x: 2 * x)])(df)
    return one_row(spark, n=answers[0], total=answers[1], twice=answers[2])


@query("SELECT l_returnflag AS part, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM lineitem WHERE l_quantity > 10")
def accountant(spark, sf_dir):
    df = lines(spark, sf_dir, "l_quantity", "l_returnflag")
    domain = dense(df)
    root = PrivacyAccountant.launch(SequentialComposition(domain, HammingDistance(), PureDP(), 1, INFINITY), df)
    root.transform_in_place(HammingDistanceToSymmetricDifference(domain))
    root.transform_in_place(rows.Filter(domain, SD, "l_quantity > 10"))
    count = lambda a: a.measure(releases.create_count_measurement(domain, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC, d_in=2))
    found = [("all", int(count(root)))]
    flags = [r[0] for r in df.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    parts = root.split(rows.PartitionByKeys(domain, SD, False, ["l_returnflag"], [(k,) for k in flags]), INFINITY)
    for flag, part in zip(flags, parts):
        found.append((flag, int(count(part))))
        part.retire()
    root.retire()
    return spark.createDataFrame(found, "part string, n long")


# -- with noise: rows only


@query(None)
def noisy_count(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linestatus")
    domain = dense(df)
    return releases.create_count_measurement(domain, SD, PureDP(), 1, NoiseMechanism.GEOMETRIC, groupby_transformation=_groups(df, domain))(df)


@query(None)
def noisy_average(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity")
    domain = dense(df)
    return releases.create_average_measurement(domain, SD, RhoZCDP(), "1/2", NoiseMechanism.GAUSSIAN, "l_quantity", 0, 50, groupby_transformation=_groups(df, domain, True))(df)


@query(None)
def noisy_partition_selection(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").select("c_mktsegment")
    return releases.create_partition_selection_measurement(dense(df), 1, "1/1000000")(df)


from quietframe import catalogue_numbers, catalogue_parts  # noqa: E402, F401  their queries are kept here too
