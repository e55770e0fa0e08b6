"""Queries of functions of numbers, over columns of the tables, with their SQL.

The functions run in Spark's tasks, once for each distinct row of a few columns;
SQL has the same rows and formulas of its own.
"""

from __future__ import annotations

import contextlib
import io
import math
from collections.abc import Callable, Iterable
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quietframe.catalogue import SD, dense, fixed_loss, query
from quietframe.functions import batches, distributions, helpers, samplers
from quietframe.functions.exact import ExactNumber
from quietframe.operators import noise, releases
from quietframe.operators.noise import NoiseMechanism
from quietframe.plans import core, domains, errors, measures, metrics
from quietframe.plans.domains import DictDomain, ListDomain, NumpyFloatDomain, NumpyIntegerDomain, NumpyStringDomain, PandasDataFrameDomain, PandasSeriesDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor
from quietframe.plans.measures import ApproxDP, PureDP, RhoZCDP
from quietframe.sources import shared
from quietframe.sources.shared import read_table


def of_rows(df: DataFrame, schema: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    """The rows that f gives for the cells of each row, computed in Spark's tasks."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def apply(batches):
        for batch in batches:
            out = [r for cells in zip(*(c.to_pylist() for c in batch.columns)) for r in f(*cells)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow.types)], arrow.names)

    return df.mapInArrow(apply, kind)


def counted(spark, sf_dir, **columns: str) -> DataFrame:
    """The distinct rows of some expressions over ``lineitem`` and how many lines have them."""
    df = read_table(spark, sf_dir, "lineitem").select(*[F.expr(c).alias(n) for n, c in columns.items()])
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


LINE = "CAST(l_linenumber AS BIGINT)"
number = lambda x: float(x.to_float(True))
exact = lambda x: ExactNumber.from_float(float(x), True)


# -- noise


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS laplace, l_partkey AS geometric, l_suppkey AS discrete_gaussian, l_quantity::DOUBLE AS gaussian FROM lineitem")
def noise_of_scale_zero(spark, sf_dir):
    """Mechanisms of scale 0 on numbers of every line."""
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"))
    floats = NumpyFloatDomain()
    kinds = [noise.AddNoiseToSeries(m) for m in (noise.AddLaplaceNoise(floats, 0), noise.AddGeometricNoise(0), noise.AddDiscreteGaussianNoise(0), noise.AddGaussianNoise(floats, 0))]
    kind = StructType.fromDDL("l_orderkey long, l_linenumber int, laplace double, geometric long, discrete_gaussian long, gaussian double")
    arrow = to_arrow_schema(kind)

    def draw(found):
        for batch in found:
            noisy = [m(c.to_pandas()) for m, c in zip(kinds, batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, t) for x, t in zip(noisy, arrow.types[2:]))], arrow.names)

    return df.mapInArrow(draw, kind)


@query("SELECT l_linenumber::BIGINT AS d, l_quantity / 4 AS e, count(*) AS n, round(l_linenumber / (l_quantity / 4), 9) AS pure, round(l_linenumber / sqrt(2 * l_quantity / 4), 9) AS zcdp FROM lineitem GROUP BY l_linenumber, l_quantity")
def noise_scales(spark, sf_dir):
    scale = lambda d, e, measure: round(number(noise.calculate_noise_scale(d, exact(e), measure)), 9)
    return of_rows(counted(spark, sf_dir, d=LINE, e="l_quantity / 4"), "d long, e double, n long, pure double, zcdp double", lambda d, e, n: [(d, e, n, scale(d, e, PureDP()), scale(d, e, RhoZCDP()))])


@query("SELECT l_linenumber::BIGINT AS d, count(*) AS n, l_linenumber / 4.0::DOUBLE AS laplace, l_linenumber / 4.0::DOUBLE AS geometric, l_linenumber * l_linenumber / 8.0::DOUBLE AS discrete_gaussian, l_linenumber * l_linenumber / 8.0::DOUBLE AS gaussian FROM lineitem GROUP BY l_linenumber")
def noise_losses(spark, sf_dir):
    """What mechanisms of scale 4, or variance 4, lose."""

    def losses(d, n):
        kinds = noise.AddLaplaceNoise(NumpyFloatDomain(), 4), noise.AddGeometricNoise(4), noise.AddDiscreteGaussianNoise(4), noise.AddGaussianNoise(NumpyFloatDomain(), 4)
        yield d, n, *(number(m.privacy_function(d)) for m in kinds)

    return of_rows(counted(spark, sf_dir, d=LINE), "d long, n long, laplace double, geometric double, discrete_gaussian double, gaussian double", losses)


_Q, _G = math.exp(-0.5), math.exp(-1 / 2)
_each = lambda draw: lambda n: [draw() for _ in range(n)]
#: Samplers: so many draws, the mean and the variance that they should have.  Those that cost more than some microseconds a draw draw in batches.
_SAMPLERS = {
    "uniform_below": (_each(lambda: samplers.uniform_below(10)), 4.5, 8.25), "bernoulli": (_each(lambda: samplers.bernoulli(Fraction(1, 4))), 0.25, 0.1875), "bernoulli_exp": (_each(lambda: samplers.bernoulli_exp(Fraction(1, 2))), _Q, _Q * (1 - _Q)),
    "geometric_exp": (lambda n: batches.geometric_exp(Fraction(1, 2), n), _G / (1 - _G), _G / (1 - _G) ** 2), "discrete_laplace": (lambda n: batches.discrete_laplace(Fraction(2), n), 0, 2 * _G / (1 - _G) ** 2), "discrete_gaussian": (lambda n: batches.discrete_gaussian(Fraction(9), n), 0, 9),
    "laplace": (lambda n: batches.laplace(np.ones(n), 2.0), 1, 8), "gaussian": (lambda n: batches.gaussian(np.zeros(n), Fraction(4)), 0, 4), "uniform": (lambda n: batches.uniform(2.0, 5.0, n), 3.5, 0.75), "RNGWrapper": (_each(lambda: samplers.RNGWrapper().randrange(10)), 4.5, 8.25),
}


@query(f"SELECT sampler, (SELECT count(*) FROM orders) AS n, true AS fits FROM (VALUES {', '.join(f'({k!r})' for k in _SAMPLERS)}) t(sampler)")
def sampler_distributions(spark, sf_dir):
    """One draw of each sampler an order, taken in Spark's tasks: mean and variance, within what they miss once in some millions."""
    names = list(_SAMPLERS)

    def draws(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(draw(batch.num_rows), np.float64)) for draw, _, _ in _SAMPLERS.values()], names)

    drawn = shared.spread(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").mapInArrow(draws, ", ".join(f"{k} double" for k in names))
    moments = [F.struct(F.lit(k).alias("sampler"), F.count(k).alias("n"), F.avg(k).alias("m"), F.var_pop(k).alias("v")) for k in names]
    law = spark.createDataFrame([(k, float(m), float(v)) for k, (_, m, v) in _SAMPLERS.items()], "sampler string, mean double, variance double")
    # sixth moments are not needed: fourth ones of these laws are at most 24 variances squared
    seen = drawn.agg(F.array(*moments).alias("all")).select(F.inline("all")).join(F.broadcast(law), "sampler")
    near = (F.abs(F.col("m") - F.col("mean")) < 6 * F.sqrt(F.col("variance") / F.col("n"))) & (F.abs(F.col("v") / F.col("variance") - 1) < 6 * F.sqrt(24 / F.col("n")))
    return seen.select("sampler", "n", near.alias("fits"))


# -- distributions


_GEOMETRIC = "SELECT k, a, (exp(1 / a) - 1) / (exp(1 / a) + 1) * exp(-abs(k) / a) AS mass FROM range(-300, 301) t(k), (SELECT DISTINCT l_quantity / 10 AS a FROM lineitem)"
_SEEN = "(SELECT l_linenumber AS line, l_quantity AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"WITH g AS ({_GEOMETRIC}), c AS (SELECT *, sum(mass) OVER (PARTITION BY a ORDER BY k) AS upto FROM g) SELECT k, a, n, round(mass, 9) AS pmf, round(upto, 9) AS cmf, round(upto, 9) AS cmf_exact FROM c JOIN {_SEEN} ON k = line - 4 AND a = quantity / 10")
def geometric_distribution(spark, sf_dir):
    d = distributions
    values = lambda k, a, n: [(k, a, n, round(float(d.double_sided_geometric_pmf(k, a)), 9), round(float(d.double_sided_geometric_cmf(k, a)), 9), round(d.double_sided_geometric_cmf_exact(k, ExactNumber.from_float(a, False)).to_float(False), 9))]
    return of_rows(counted(spark, sf_dir, k=f"{LINE} - 4", a="l_quantity / 10"), "k long, a double, n long, pmf double, cmf double, cmf_exact double", values)


@query(f"WITH g AS (SELECT k, a, sum(mass) OVER (PARTITION BY a ORDER BY k) AS upto FROM ({_GEOMETRIC})) SELECT line / 8.0::DOUBLE AS p, a, n, min(k) AS k, min(k) AS k_exact FROM g JOIN {_SEEN} ON a = quantity / 10 WHERE upto >= line / 8.0::DOUBLE GROUP BY 1, 2, 3")
def geometric_inverse(spark, sf_dir):
    d = distributions
    inverse = lambda p, a: int(d.double_sided_geometric_inverse_cmf_exact(ExactNumber.from_float(p, False), ExactNumber.from_float(a, False)).to_fraction())
    return of_rows(counted(spark, sf_dir, p=f"{LINE} / 8", a="l_quantity / 10"), "p double, a double, n long, k long, k_exact long", lambda p, a, n: [(p, a, n, int(d.double_sided_geometric_inverse_cmf(p, a)), inverse(p, a))])


_GAUSS = "SELECT k, s, exp(-k * k / (2 * s)) / sum(exp(-k * k / (2 * s))) OVER (PARTITION BY s) AS mass FROM range(-200, 201) t(k), (SELECT DISTINCT l_quantity / 2 AS s FROM lineitem)"


@query(f"WITH g AS ({_GAUSS}), c AS (SELECT *, sum(mass) OVER (PARTITION BY s ORDER BY k) AS upto FROM g) SELECT k, s, n, round(mass, 9) AS pmf, round(upto, 9) AS cmf FROM c JOIN {_SEEN} ON k = line - 4 AND s = quantity / 2")
def discrete_gaussian_distribution(spark, sf_dir):
    d = distributions
    return of_rows(counted(spark, sf_dir, k=f"{LINE} - 4", s="l_quantity / 2"), "k long, s double, n long, pmf double, cmf double", lambda k, s, n: [(k, s, n, round(float(d.discrete_gaussian_pmf(k, s)), 9), round(float(d.discrete_gaussian_cmf(k, s)), 9))])


@query(f"WITH g AS ({_GAUSS}), c AS (SELECT *, sum(mass) OVER (PARTITION BY s ORDER BY k) AS upto FROM g) SELECT line / 8.0::DOUBLE AS p, s, n, min(k) AS k FROM c JOIN {_SEEN} ON s = quantity / 2 WHERE upto >= line / 8.0::DOUBLE GROUP BY 1, 2, 3")
def discrete_gaussian_inverse(spark, sf_dir):
    return of_rows(counted(spark, sf_dir, p=f"{LINE} / 8", s="l_quantity / 2"), "p double, s double, n long, k long", lambda p, s, n: [(p, s, n, int(distributions.discrete_gaussian_inverse_cmf(p, s)))])


# -- losses and budgets


@query("SELECT l_quantity / 4 AS e, count(*) AS n, round(l_quantity * l_quantity / 32, 9) AS rho, l_quantity / 4 AS epsilon, 0.0::DOUBLE AS delta FROM lineitem GROUP BY l_quantity")
def converted_losses(spark, sf_dir):
    def losses(e, n):
        m = fixed_loss(PureDP(), exact(e))
        epsilon, delta = core.PureDPToApproxDP(m).privacy_function(1)
        yield e, n, round(number(core.PureDPToRhoZCDP(m).privacy_function(1)), 9), number(epsilon), number(delta)

    return of_rows(counted(spark, sf_dir, e="l_quantity / 4"), "e double, n long, rho double, epsilon double, delta double", losses)


@query("SELECT l_quantity::DOUBLE AS quantity, l_linenumber::BIGINT AS line, round(l_discount * 100)::BIGINT AS discount, count(*) AS n, l_quantity / 10 + 2 * sqrt(l_quantity / 10 * ln(pow(10.0, l_linenumber))) <= round(l_discount * 100)::BIGINT * 2.5 AS holds FROM lineitem GROUP BY l_quantity, l_linenumber, round(l_discount * 100)")
def rho_zcdp_to_approx_dp(spark, sf_dir):
    """Whether a loss of rho, a tenth of the quantity, is one of (2.5 x hundredths of discount, 10**-line)."""
    tenth = lambda q: ExactNumber(Fraction(int(q), 10))
    holds = lambda q, line, discount, n: [(q, line, discount, n, bool(core.RhoZCDPToApproxDP(fixed_loss(RhoZCDP(), tenth(q))).privacy_relation(1, (ExactNumber(Fraction(5 * discount, 2)), ExactNumber(Fraction(1, 10**line))))))]
    return of_rows(counted(spark, sf_dir, quantity="l_quantity", line=LINE, discount="CAST(round(l_discount * 100) AS BIGINT)"), "quantity double, line long, discount long, n long, holds boolean", holds)


@query("SELECT kind, l_quantity / 8 AS a, l_linenumber::DOUBLE AS b, count(*) AS n, CASE WHEN l_linenumber <= l_quantity / 8 THEN l_quantity / 8 - l_linenumber END AS remaining, l_linenumber <= l_quantity / 8 AS enough FROM lineitem, (VALUES ('PureDPBudget'), ('RhoZCDPBudget'), ('ApproxDPBudget')) k(kind) GROUP BY kind, l_quantity, l_linenumber")
def budgets(spark, sf_dir):
    def spent(a, b, n):
        for kind in (measures.PureDPBudget, measures.RhoZCDPBudget, measures.ApproxDPBudget):
            budget, loss = (kind((exact(x), 0) if kind is measures.ApproxDPBudget else exact(x)) for x in (a, b))
            try:
                left = budget.subtract(loss).value
                left = number(left[0] if isinstance(left, tuple) else left)
            except errors.InsufficientBudgetError:
                left = None
            yield kind.__name__, a, b, n, left, bool(budget.can_spend_budget(loss))

    return of_rows(counted(spark, sf_dir, a="l_quantity / 8", b="CAST(l_linenumber AS DOUBLE)"), "kind string, a double, b double, n long, remaining double, enough boolean", spent)


@query("SELECT l_quantity / 8 AS a, l_linenumber::DOUBLE AS b, count(*) AS n, l_quantity / 8 <= l_linenumber AS pure, l_quantity / 8 <= l_linenumber AS zcdp, l_quantity / 8 <= l_linenumber AS approx FROM lineitem GROUP BY l_quantity, l_linenumber")
def measures_compare(spark, sf_dir):
    compare = lambda a, b, n: [(a, b, n, bool(PureDP().compare(exact(a), exact(b))), bool(RhoZCDP().compare(exact(a), exact(b))), bool(ApproxDP().compare((exact(a), "1/4"), (exact(b), "1/2"))))]
    return of_rows(counted(spark, sf_dir, a="l_quantity / 8", b="CAST(l_linenumber AS DOUBLE)"), "a double, b double, n long, pure boolean, zcdp boolean, approx boolean", compare)


@query("SELECT -line AS low, top AS high, count(*) AS n, greatest(top * top, line * line) / 2 AS squares, (top + line) / 2 AS deviations FROM (SELECT l_linenumber::BIGINT AS line, (ceil(l_quantity / 10) * 10)::BIGINT AS top FROM lineitem) GROUP BY line, top")
def variance_sensitivities(spark, sf_dir):
    """How far one row moves the sums of a variance: half of the range of squares, and of values."""

    def moved(low, high, n):
        domain = SparkDataFrameDomain({"x": SparkFloatColumnDescriptor()})
        parts = releases.create_variance_measurement(domain, SD, PureDP(), 1, NoiseMechanism.LAPLACE, "x", low, high).parts
        yield low, high, n, number(parts[1].sensitivity), number(parts[0].sensitivity)

    seen = counted(spark, sf_dir, low=f"-{LINE}", high="CAST(ceil(l_quantity / 10) * 10 AS BIGINT)").collect()  # expressions are built on the driver
    return spark.createDataFrame([r for low, high, n in seen for r in moved(low, high, n)], "low long, high long, n long, squares double, deviations double")


# -- domains and numbers


@query("""SELECT name, type, size, (SELECT count(*) FROM lineitem) AS n FROM (VALUES ('l_orderkey', 'bigint', 64), ('l_linenumber', 'int', 32), ('l_quantity', 'double', 64), ('narrow', 'float', 32), ('l_returnflag', 'string', NULL), ('day', 'date', NULL), ('l_shipdate', 'timestamp', NULL)) t(name, type, size)""")
def column_descriptors(spark, sf_dir):
    """Descriptors of a table's columns, which all its rows are held against."""
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_tax").cast("float").alias("narrow"), "l_returnflag", F.col("l_shipdate").cast("date").alias("day"), F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    schema = dense(df).schema
    SparkDataFrameDomain(schema).validate(df)
    n = df.count()
    return spark.createDataFrame([(c, d.data_type.simpleString(), getattr(d, "size", None), n) for c, d in schema.items()], "name string, type string, size int, n long")


@query("SELECT name, kind, (SELECT count(*) FROM orders) AS n FROM (VALUES ('o_orderkey', 'SparkIntegerColumnDescriptor'), ('o_totalprice', 'SparkFloatColumnDescriptor'), ('o_orderstatus', 'SparkStringColumnDescriptor')) t(name, kind)")
def pandas_descriptors(spark, sf_dir):
    """Descriptors of pandas domains, with the rows of frames, a batch of a task each, that they take."""
    numpy = {"o_orderkey": NumpyIntegerDomain(), "o_totalprice": NumpyFloatDomain(), "o_orderstatus": NumpyStringDomain()}
    domain = PandasDataFrameDomain({c: PandasSeriesDomain(d) for c, d in numpy.items()})
    kinds = {c: type(d).__name__ for c, d in domains.convert_pandas_domain(domain).items() if type(d) is type(domains.convert_numpy_domain(numpy[c]))}

    def taken(frames):
        for frame in frames:
            domain.validate(frame)
            yield pd.DataFrame({"name": list(kinds), "kind": list(kinds.values()), "n": len(frame)})

    return read_table(spark, sf_dir, "orders").select(*numpy).mapInPandas(taken, "name string, kind string, n long").groupBy("name", "kind").agg(F.sum("n").alias("n"))


_MEMBERS = ("int", "float", "string", "series", "frame", "list", "dict")


@query(f"SELECT domain, own, other FROM (SELECT domain, (SELECT count(*) FROM customer) AS own, 0 AS other FROM (VALUES {', '.join(f'({k!r})' for k in _MEMBERS)}) t(domain)) UNION ALL SELECT domain, (SELECT count(*) FROM orders), 0 FROM (VALUES ('table'), ('day'), ('moment')) t(domain)")
def domain_membership(spark, sf_dir):
    """How many values of each customer a domain of their kind takes, and how many of another kind; whole tables for domains of tables."""
    whole = NumpyIntegerDomain()

    def takes(domain, value) -> int:
        try:
            domain.validate(value)
            return 1
        except (errors.OutOfDomainError, TypeError, ValueError):
            return 0

    floats, texts, series, many, named = NumpyFloatDomain(), NumpyStringDomain(), PandasSeriesDomain(whole), ListDomain(whole), DictDomain({"k": whole})
    table = PandasDataFrameDomain({"a": series})

    def members(found):
        """Single values one by one; a series or frame has the values of a batch, all of which its domain looks at."""
        for batch in found:
            n = batch.num_rows
            if not n:
                continue
            keys, names, balances = (c.to_pylist() for c in batch.columns)
            numbers, frame = [np.int64(k) for k in keys], pd.DataFrame({"a": keys})
            each = lambda domain, values: sum(takes(domain, v) for v in values)
            counts = {
                "int": (each(whole, numbers), each(whole, map(np.float64, balances))), "float": (each(floats, map(np.float64, balances)), each(floats, [np.float64("nan")] * n)), "string": (each(texts, names), each(texts, [None] * n)),
                "series": (n * takes(series, frame["a"]), n * takes(series, pd.Series(names))), "frame": (n * takes(table, frame), n * takes(table, frame.rename(columns={"a": "b"}))),
                "list": (each(many, ([i] for i in numbers)), each(many, ([x] for x in names))), "dict": (each(named, ({"k": i} for i in numbers)), each(named, ({"j": i} for i in numbers))),
            }
            yield pa.RecordBatch.from_pylist([{"domain": k, "own": own, "other": other} for k, (own, other) in counts.items()])

    customers = shared.spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    rows = customers.mapInArrow(members, "domain string, own long, other long")
    out = rows.groupBy("domain").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    orders = read_table(spark, sf_dir, "orders")
    n = orders.count()
    tables = {"table": (orders.select("o_orderkey"), None), "day": (orders.select(F.col("o_orderdate").cast("date").alias("d")), domains.SparkDateColumnDescriptor()), "moment": (orders.select(F.col("o_orderdate").cast("timestamp").alias("d")), domains.SparkTimestampColumnDescriptor())}
    found = []
    for kind, (df, descriptor) in tables.items():
        domain = dense(df) if descriptor is None else SparkDataFrameDomain({"d": descriptor})
        found.append((kind, n * takes(domain, df), n * takes(domain, orders.select(F.col("o_orderkey").alias("other")))))
    return out.unionByName(spark.createDataFrame(found, "domain string, own long, other long"))


@query("SELECT l_linenumber::BIGINT AS line, l_quantity::BIGINT AS quantity, count(*) AS n, round(l_quantity / l_linenumber + 1 / 6, 9) AS sum, round(sqrt(l_quantity) * sqrt(8), 9) AS roots, round((1 + sqrt(l_linenumber)) ** 2, 9) AS power, round(2.0::DOUBLE ** -l_linenumber, 9) AS inverse FROM lineitem GROUP BY l_linenumber, l_quantity")
def exact_numbers(spark, sf_dir):
    """Expressions as text, with numbers of each line, evaluated exactly."""
    value = lambda text: round(number(ExactNumber(text)), 9)
    return of_rows(
        counted(spark, sf_dir, line=LINE, quantity="CAST(l_quantity AS BIGINT)"), "line long, quantity long, n long, sum double, roots double, power double, inverse double",
        lambda a, q, n: [(a, q, n, value(f"{q}/{a} + 1/6"), value(f"sqrt({q}) * sqrt(8)"), value(f"(1 + sqrt({a})) ** 2"), value(f"2 ** -{a}"))],
    )


# -- helpers


@query("SELECT c_custkey, c_nationkey AS escaped, 7 AS fresh FROM customer")
def column_names(spark, sf_dir):
    """A column whose name has a quote and a space, and a new one under a name that no other has."""
    odd = "a`b c0"
    df = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias(odd))
    fresh = shared.get_nonconflicting_string(["c0", "C1", *df.columns])
    assert fresh.lower() not in {"c0", "c1", odd}
    return df.withColumn(fresh, F.lit(7)).select("c_custkey", F.col(shared.escape_column_name(odd)).alias("escaped"), F.col(fresh).alias("fresh"))


@query("SELECT c_custkey, 'str' AS element, c_nationkey::BIGINT AS copied, 'decimal.Decimal' AS fullname, true AS frozen, 'AssertionError' AS never FROM customer")
def object_helpers(spark, sf_dir):
    """Helpers of plans on values of each customer."""

    def helped(key, nation, name):
        mutable = [nation]
        copied = helpers.copy_if_mutable(mutable)
        mutable.append(-1)
        try:
            helpers.assert_never(name)
        except AssertionError as e:
            never = type(e).__name__
        yield key, helpers.get_element_type([name, None]).__name__, sum(copied), helpers.get_fullname(Decimal(key)), isinstance(name, helpers.get_immutable_types()), never

    return of_rows(read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long"), "c_name"), "c_custkey long, element string, copied long, fullname string, frozen boolean, never string", helped)


@query("SELECT n_name, n_regionkey, true AS printed FROM nation")
def printed_table(spark, sf_dir):
    """A table as it is printed, in the order of its columns: a line a row."""
    df = read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        shared.print_sdf(df)
    lines = spark.createDataFrame([(line.split()[0], " ".join(line.split()[1:])) for line in text.getvalue().splitlines()[1:]], "place string, line string")
    wanted = df.select("n_name", "n_regionkey", F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return wanted.join(lines, "line", "left").select("n_name", "n_regionkey", F.col("place").isNotNull().alias("printed"))


@query("SELECT o_orderkey, 'UnsupportedExpressionError' AS refused, 'NotImplementedError' AS no_distance FROM orders")
def refused_values(spark, sf_dir):
    """What is no exact number, and a metric that has no distances, with values of orders."""

    def refused(key, status):
        found = []
        for attempt in (lambda: ExactNumber(f"x_{status} + {key}"), lambda: metrics.NullMetric().distance(key, key, NumpyIntegerDomain())):
            try:
                attempt()
                found.append("nothing")
            except Exception as e:  # the kinds of errors are what is shown
                found.append(type(e).__name__)
        yield key, *found

    return of_rows(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey long, refused string, no_distance string", refused)
