"""Operators and their guarantees on small tables."""

import datetime
import math
import random
import statistics
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.operators import grouped, joins, maps, noise, releases, rows, tables, truncation
from quietframe.operators.noise import NoiseMechanism
from quietframe.plans import core, errors
from quietframe.plans import interactive as ia
from quietframe.plans.domains import *  # noqa: F403
from quietframe.plans.domains import DictDomain, ListDomain, NumpyFloatDomain, NumpyIntegerDomain, PandasSeriesDomain, SparkDataFrameDomain, SparkDateColumnDescriptor, SparkFloatColumnDescriptor, SparkIntegerColumnDescriptor, SparkRowDomain, SparkStringColumnDescriptor
from quietframe.plans.measures import ApproxDP, ApproxDPBudget, PrivacyBudget, PureDP, PureDPBudget, RhoZCDP
from quietframe.plans.metrics import AbsoluteDifference, AddRemoveKeys, DictMetric, HammingDistance, IfGroupedBy, OnColumn, RootSumOfSquared, SumOf, SymmetricDifference

SD, HD = SymmetricDifference(), HammingDistance()
INT, STR, FLOAT = SparkIntegerColumnDescriptor(), SparkStringColumnDescriptor(), SparkFloatColumnDescriptor()
AB = SparkDataFrameDomain({"A": STR, "B": INT})


def make(spark, data, schema="A string, B long"):
    return spark.createDataFrame(data, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_domain_checks(spark):
    AB.validate(make(spark, [("x", 1)]))
    for bad in (make(spark, [(None, 1)]), make(spark, [("x", 1)], "A string, B int"), make(spark, [("x", 1)], "B string, A long"), 3):
        assert bad not in AB
    floats = SparkDataFrameDomain({"v": SparkFloatColumnDescriptor(allow_inf=True)})
    assert make(spark, [(math.inf,)], "v double") in floats
    with pytest.raises(errors.OutOfDomainError, match="NaN"):
        floats.validate(make(spark, [(math.nan,)], "v double"))
    assert not SparkIntegerColumnDescriptor(size=32).valid_py_value(2**31) and INT.valid_py_value(2**31)
    assert not SparkFloatColumnDescriptor(size=32).valid_py_value(0.1) and SparkDateColumnDescriptor().valid_py_value(datetime.date(2020, 1, 1))
    with pytest.raises(errors.DomainColumnError):
        AB["C"]
    with pytest.raises(errors.DomainKeyError):
        DictDomain({"a": AB})["b"]
    assert [1] not in ListDomain(AB, 2)


@pytest.mark.parametrize("one,two,sd,hd", [([("x", 1)], [("x", 1)], 0, 0), ([("x", 1), ("x", 1)], [("x", 1)], 1, INFINITY), ([("x", 1)], [("y", 1)], 2, 1), ([], [], 0, 0)])
def test_row_distances(spark, one, two, sd, hd):
    a, b = make(spark, one), make(spark, two)
    assert SD.distance(a, b, AB) == sd and HD.distance(a, b, AB) == hd


def test_other_distances(spark):
    a, b = make(spark, [("x", 1), ("x", 2), ("y", 3)]), make(spark, [("x", 1), ("z", 3)])
    assert IfGroupedBy("A", SD).distance(a, b, AB) == 4  # x changed, y gone, z new
    assert IfGroupedBy("A", SumOf(SD)).distance(a, b, AB) == 3
    assert IfGroupedBy("A", RootSumOfSquared(SD)).distance(a, b, AB) == ExactNumber.sqrt(3)
    assert AddRemoveKeys({"t": "A"}).distance({"t": a}, {"t": b}, DictDomain({"t": AB})) == 4
    assert OnColumn("B", SumOf(AbsoluteDifference())).distance(make(spark, [("x", 1)]), make(spark, [("x", 5)]), AB) == 4
    assert SumOf(AbsoluteDifference()).distance(pd.Series([1, 2]), pd.Series([4, 2]), PandasSeriesDomain(NumpyIntegerDomain())) == 3
    assert AbsoluteDifference().distance(np.int64(3), np.int64(-1), NumpyIntegerDomain()) == 4
    assert DictMetric({"t": SD}).compare({"t": 1}, {"t": 2}) and not SD.supports_domain(NumpyFloatDomain())
    for bad in (-1, "1/2"):
        with pytest.raises(ValueError):
            SD.validate(bad)


def test_budgets():
    assert PureDPBudget(3).subtract(1) == PureDPBudget(2)
    assert PureDPBudget(INFINITY).subtract(5) == PureDPBudget(INFINITY)
    with pytest.raises(errors.InsufficientBudgetError):
        ApproxDPBudget((1, "0.1")).subtract((1, "0.2"))
    assert ApproxDP().compare((5, 0), (INFINITY, 0)) and ApproxDP().compare((5, "0.5"), (1, 1)) and not ApproxDP().compare((2, 0), (1, "0.5"))
    with pytest.raises(ValueError):
        PrivacyBudget.cast(PureDP(), ApproxDPBudget((1, 0)))


def test_special_values(spark):
    domain = SparkDataFrameDomain({"v": SparkFloatColumnDescriptor(True, True, True)})
    df = make(spark, [(None,), (math.nan,), (math.inf,), (-math.inf,), (1.0,)], "v double")
    names = lambda x: sorted(str(r.v) for r in x.collect())
    assert names(rows.DropNulls(domain, SD, ["v"])(df)) == ["-inf", "1.0", "inf", "nan"]
    assert names(rows.DropNaNs(domain, SD, ["v"])(df)) == ["-inf", "1.0", "None", "inf"]
    assert names(rows.DropInfs(domain, SD, ["v"])(df)) == ["1.0", "None", "nan"]
    t = rows.ReplaceInfs(domain, HD, {"v": (-5.0, 5.0)})
    assert names(t(df)) == ["-5.0", "1.0", "5.0", "None", "nan"] and not t.output_domain["v"].allow_inf and t.stability_function(2) == 2
    assert names(rows.ReplaceNulls(domain, SD, {"v": 0.5})(df)) == ["-inf", "0.5", "1.0", "inf", "nan"]
    assert names(rows.ReplaceNaNs(domain, SD, {"v": 0.5})(df)) == ["-inf", "0.5", "1.0", "None", "inf"]
    with pytest.raises(errors.UnsupportedMetricError):
        rows.DropNaNs(domain, HD, ["v"])
    with pytest.raises(ValueError):
        rows.ReplaceNaNs(domain, SD, {"v": "text"})


def test_row_operators(spark):
    df = make(spark, [("x", 1), ("x", 1), ("y.z", 2)])
    assert got(rows.Select(AB, HD, ["B"])(df)) == [(1,), (1,), (2,)]
    assert rows.Rename(AB, IfGroupedBy("A", SD), {"A": "C"}).output_metric == IfGroupedBy("C", SD)
    assert got(rows.Filter(AB, SD, "B > 1 AND A LIKE 'y%'")(df)) == [("y.z", 2)]
    for bad in ("C > 1", "B >", "count(*) > 1"):
        with pytest.raises(ValueError):
            rows.Filter(AB, SD, bad)
    with pytest.raises(errors.UnsupportedMetricError):
        rows.Filter(AB, HD, "B > 1")
    ids = rows.AddUniqueColumn(AB, "id")(df)
    assert ids.select("id").distinct().count() == 3
    assert got(ids) == got(rows.AddUniqueColumn(AB, "id")(df.repartition(3)))
    parts = rows.PartitionByKeys(AB, SD, True, ["A"], [("x",), ("q",)])
    assert [p.count() for p in parts(df)] == [2, 0] and parts.output_metric == RootSumOfSquared(SD)
    dotted = SparkDataFrameDomain({"a.b": INT})
    assert got(rows.Rename(dotted, SD, {"a.b": "c"})(make(spark, [(1,)], "`a.b` long"))) == [(1,)]


def test_join_truth_table(spark):
    left, right = make(spark, [(1, "a"), (None, "b"), (3, "c")], "k long, v string"), make(spark, [(1, "x"), (None, "y"), (4, "z")], "k long, v string")
    want = {
        ("inner", False): [(1, "a", "x")], ("inner", True): [(1, "a", "x"), (None, "b", "y")],
        ("left", False): [(1, "a", "x"), (3, "c", None), (None, "b", None)], ("right", False): [(1, "a", "x"), (4, None, "z"), (None, None, "y")],
        ("outer", True): [(1, "a", "x"), (3, "c", None), (4, None, "z"), (None, "b", "y")], ("left_anti", False): [(3, "c"), (None, "b")], ("left_anti", True): [(3, "c")],
    }
    for (how, equal), rows_ in want.items():
        assert got(joins.join(left, right, ["k"], how, equal)) == sorted(rows_, key=str), (how, equal)
    assert joins.columns_after_join(["a", "b"], ["b", "a", "c"], ["b"]) == {"b": ("b", "b"), "a_left": ("a", None), "a_right": (None, "a"), "c": (None, "c")}
    for on, how in ((["q"], "inner"), ([], "inner"), (["k", "k"], "inner"), (["k"], "cross")):
        with pytest.raises(ValueError):
            joins.join(left, right, on, how)
    with pytest.raises(ValueError, match="data types"):
        joins.join(left, make(spark, [(1,)], "k int"))


def test_public_join(spark):
    public = make(spark, [("x", 10), ("x", 11), (None, 3)], "A string, C long")
    t = joins.PublicJoin(AB, SD, public)
    assert t.stability == 2 and t.stability_function(3) == 6
    assert got(t(make(spark, [("x", 1), ("y", 2)]))) == [("x", 1, 10), ("x", 1, 11)]
    assert joins.PublicJoin(AB, IfGroupedBy("A", SD), public).stability_function(3) == 3
    assert joins.PublicJoin(AB, SD, public.limit(0), how="left").stability == 1
    nans = SparkDataFrameDomain({"v": SparkFloatColumnDescriptor(allow_nan=True)})
    twice = make(spark, [(math.nan, 1), (math.nan, 2)], "v double, w long")
    t = joins.PublicJoin(nans, SD, twice)
    assert t.stability == 2 and t(make(spark, [(math.nan,)], "v double")).count() == 2


def test_private_join(spark):
    domain = DictDomain({"l": AB, "r": SparkDataFrameDomain({"A": STR, "C": INT})})
    S = joins.TruncationStrategy
    t = joins.PrivateJoin(domain, "l", "r", S.TRUNCATE, S.DROP, 2, 3)
    assert t.stability_function({"l": 1, "r": 1}) == 2 * 3 * 1 + 3 * 2 * 1
    data = {"l": make(spark, [("x", i) for i in range(5)] + [("y", 1)]), "r": make(spark, [("x", 1), ("x", 2)] + [("y", i) for i in range(4)], "A string, C long")}
    assert t(data).count() == 4
    free = joins.PrivateJoin(domain, "l", "r", S.NO_TRUNCATION, S.NO_TRUNCATION, math.inf, math.inf)
    assert free.stability_function({"l": 1, "r": 0}) == INFINITY and free(data).count() == 14


def test_truncation(spark, monkeypatch):
    df = make(spark, [("x", i) for i in range(20)] * 3 + [("y", 1), (None, 2)])
    once = got(truncation.truncate_large_groups(df, ["A"], 5))
    assert once == got(truncation.truncate_large_groups(df.repartition(7).orderBy(F.rand()), ["A"], 5))
    assert len(once) == 7 and len({r for r in once if r[0] == "x"}) > 2
    other = df.union(make(spark, [("q", i) for i in range(50)]))
    assert [r for r in got(truncation.truncate_large_groups(other, ["A"], 5)) if r[0] != "q"] == once
    assert got(truncation.drop_large_groups(df, ["A"], 1)) == [("y", 1), (None, 2)]
    assert truncation.limit_keys_per_group(df, ["A"], ["B"], 4).count() == 4 * 3 + 2
    assert truncation.drop_large_groups(df, [], 10).count() == 0
    monkeypatch.setattr(truncation, "UNLIMITED", 0)
    assert once == got(truncation.truncate_large_groups(df, ["A"], 5))
    g = IfGroupedBy("A", SD)
    assert truncation.LimitRowsPerGroup(AB, SD, "A", 3).stability_function(2) == 6
    assert truncation.LimitKeysPerGroup(AB, IfGroupedBy("B", RootSumOfSquared(g)), "A", "B", 3).stability_function(2) == 2 * ExactNumber.sqrt(3)
    assert truncation.LimitRowsPerKeyPerGroup(AB, IfGroupedBy("B", SumOf(g)), "A", "B", 3).output_metric == SD
    floats = make(spark, [("x", math.nan), ("x", math.inf), ("x", 1.2), ("x", 1.9), ("x", None)], "A string, B double")
    assert truncation.truncate_large_groups(floats, ["A"], 4).count() == 4


def test_maps(spark):
    source = {"A": STR, "B": SparkFloatColumnDescriptor(allow_nan=True, allow_null=True)}
    df = make(spark, [("x", math.nan), ("y", None), ("z", 2.0)], "A string, B double")
    keep = maps.RowToRowTransformation(SparkRowDomain(source), SparkRowDomain(source | {"kind": STR}), lambda r: {"kind": "null" if r.B is None else "nan" if r.B != r.B else "number"}, True)
    assert sorted((r.A, r.kind) for r in maps.Map(HD, keep)(df).collect()) == [("x", "nan"), ("y", "null"), ("z", "number")]
    wrong = maps.RowToRowTransformation(SparkRowDomain(source), SparkRowDomain({"kind": STR}), lambda r: {"kind": 3})
    with pytest.raises(Exception, match="may not hold"):
        maps.Map(SD, wrong)(df).collect()
    with pytest.raises(errors.UnsupportedCombinationError):
        maps.Map(IfGroupedBy("A", SD), wrong)
    many = maps.RowToRowsTransformation(SparkRowDomain(source), ListDomain(SparkRowDomain(source | {"i": INT})), lambda r: [{"i": 1}, {"i": 1}, {"i": 2}], True)
    assert maps.FlatMap(SD, many, 2)(df).count() == 6 and maps.FlatMap(SD, many, None).stability_function(1) == INFINITY
    t = maps.GroupingFlatMap(RootSumOfSquared(SD), many, 2)
    assert t(df).count() == 3 and t.stability_function(1) == ExactNumber.sqrt(2)
    by_key = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain({"A": STR, "B": INT})), ListDomain(SparkRowDomain({"n": INT})), lambda rs: [{"n": len(rs)}] * len(rs))
    assert got(maps.FlatMapByKey(IfGroupedBy("A", SD), by_key)(make(spark, [("x", 1), ("x", 2), ("y", 3)]))) == [("x", 2), ("x", 2), ("y", 1)]
    assert maps.FlatMapByKey(IfGroupedBy("A", SD), by_key)(make(spark, [])).collect() == []


def test_groups_and_aggregates(spark):
    df = make(spark, [("x1", 2), ("x1", 2), ("x2", 4)])
    g = grouped.create_groupby_from_column_domains(AB, SD, False, {"A": ["x1", "x2", "x3"]})
    assert got(grouped.CountGrouped(g.output_domain, g.output_metric)(g(df))) == [("x1", 2), ("x2", 1), ("x3", 0)]
    assert got(grouped.CountDistinctGrouped(g.output_domain, g.output_metric)(g(df))) == [("x1", 1), ("x2", 1), ("x3", 0)]
    s = grouped.SumGrouped(g.output_domain, g.output_metric, "B", -1, 3)
    assert got(s(g(df))) == [("x1", 4), ("x2", 3), ("x3", 0)] and s.stability_function(2) == 6
    assert grouped.GroupBy(AB, HD, True, g.group_keys).stability_function(1) == 2
    assert grouped.Count(AB, HD).stability_function(3) == 6 and grouped.Sum(AB, HD, "B", -1, 3).stability_function(1) == 4
    assert grouped.Sum(AB, SD, "B", 0, 3)(df) == 7 and grouped.Sum(AB, SD, "B", 0, 3)(df.limit(0)) == 0
    nulls = SparkDataFrameDomain({"A": SparkStringColumnDescriptor(True), "B": INT})
    g = grouped.create_groupby_from_list_of_keys(nulls, SD, False, ["A"], [(None,), ("x1",)])
    assert got(grouped.CountGrouped(g.output_domain, g.output_metric)(g(make(spark, [(None, 1), ("x1", 2), ("q", 3)])))) == sorted([(None, 1), ("x1", 1)], key=str)
    for values in ([], ["a", "a"], [3]):
        with pytest.raises(ValueError):
            grouped.create_groupby_from_column_domains(AB, SD, False, {"A": values})
    assert grouped.compute_full_domain_df({"A": ["a", "b"], "B": [1, 2, 3]}).count() == 6
    with pytest.raises(ValueError):
        grouped.Sum(AB, SD, "B", 0, "1/2")


@pytest.mark.parametrize("mechanism,measure", [(NoiseMechanism.LAPLACE, PureDP()), (NoiseMechanism.GEOMETRIC, PureDP()), (NoiseMechanism.GEOMETRIC, RhoZCDP()), (NoiseMechanism.DISCRETE_GAUSSIAN, RhoZCDP()), (NoiseMechanism.GAUSSIAN, RhoZCDP()), (NoiseMechanism.LAPLACE, ApproxDP())])
@pytest.mark.parametrize("metric", [SD, HD])
@pytest.mark.parametrize("with_groups", [True, False])
def test_builders_spend_the_budget_exactly(spark, mechanism, measure, metric, with_groups):
    g = grouped.create_groupby_from_column_domains(AB, metric, isinstance(measure, RhoZCDP), {"A": ["x", "y"]}) if with_groups else None
    budget = ("3/7", 0) if isinstance(measure, ApproxDP) else "3/7"
    shared = (AB, metric, measure, budget, mechanism)
    made = [
        releases.create_count_measurement(*shared, d_in=2, groupby_transformation=g), releases.create_count_distinct_measurement(*shared, groupby_transformation=g),
        releases.create_sum_measurement(*shared, measure_column="B", lower=-3, upper=5, d_in=3, groupby_transformation=g), releases.create_average_measurement(*shared, measure_column="B", lower=-3, upper=5, groupby_transformation=g),
        releases.create_variance_measurement(*shared, measure_column="B", lower=-3, upper=5, groupby_transformation=g), releases.create_standard_deviation_measurement(*shared, measure_column="B", lower=1, upper=5, groupby_transformation=g),
    ]
    for m, d in zip(made, (2, 1, 3, 1, 1, 1)):
        assert m.privacy_relation(d, budget)
    out = made[0](make(spark, [("x", 1)] * 5))
    assert out.count() == 2 if with_groups else isinstance(out, np.generic)


def test_illegal_builders(spark):
    with pytest.raises(errors.UnsupportedNoiseMechanismError):
        releases.create_count_measurement(AB, SD, PureDP(), 1, NoiseMechanism.GAUSSIAN)
    g = grouped.create_groupby_from_column_domains(AB, SD, False, {"A": ["x"]})
    with pytest.raises(errors.UnsupportedCombinationError):
        releases.create_count_measurement(AB, SD, RhoZCDP(), 1, NoiseMechanism.GEOMETRIC, groupby_transformation=g)
    with pytest.raises(errors.UnsupportedCombinationError):
        releases.create_count_measurement(AB, SD, ApproxDP(), (1, "0.1"), NoiseMechanism.GEOMETRIC)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_moments_against_pandas(spark, n):
    values = np.random.default_rng(n).integers(-50, 50, n)
    df = make(spark, [("x", int(v)) for v in values])
    shared = (AB, SD, PureDP(), INFINITY, NoiseMechanism.LAPLACE, "B", -100, 100)
    assert math.isclose(releases.create_average_measurement(*shared)(df), values.mean(), abs_tol=1e-9)
    var, std = releases.create_variance_measurement(*shared)(df), releases.create_standard_deviation_measurement(*shared)(df)
    if n == 1:
        assert math.isnan(var) and math.isnan(std)
    else:
        assert math.isclose(var, values.var(ddof=1), rel_tol=1e-9) and math.isclose(std, values.std(ddof=1), rel_tol=1e-9)
    g = grouped.create_groupby_from_column_domains(AB, SD, False, {"A": ["x", "none"]})
    row = {r.A: r for r in releases.create_average_measurement(*shared, groupby_transformation=g, keep_intermediates=True)(df).collect()}
    assert row["x"]["count"] == n and row["none"]["avg(B)"] == 0 and math.isclose(row["x"]["avg(B)"], values.mean(), abs_tol=1e-9)


def test_quantiles_and_bounds(spark):
    df = make(spark, [("x", i) for i in range(1, 102)])
    q = releases.create_quantile_measurement(AB, SD, PureDP(), INFINITY, "B", 0.5, 0, 200)(df)
    assert 50 <= q <= 52
    noisy = releases.create_quantile_measurement(AB, SD, RhoZCDP(), 2, "B", 0.5, 0, 200)
    assert noisy.privacy_function(1) == 2 and 0 <= noisy(df) <= 200
    same = releases.create_quantile_measurement(AB, SD, PureDP(), 1, "B", 0.3, 7, 7)
    assert same(df) == 7
    assert releases.create_bounds_measurement(AB, SD, PureDP(), INFINITY, "B", 0.95)(df) == (-128, 128)
    assert releases.create_bounds_measurement(AB, SD, RhoZCDP(), "1/3", "B", 0.95).privacy_function(1) == ExactNumber("1/3")
    ranks = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, -8, -9, 2**29, 2**29 + 1, 2**62, -(2**63), 2**63 - 1)], "v long").select("v", releases.power_rank(F.col("v"), True).alias("r")).collect()
    for r in ranks:
        assert abs(r.v) <= 2**r.r and (r.r == 0 or abs(r.v) > 2 ** (r.r - 1))
    floats = [0.0, 1.0, 1.5, 2.0**29, 2.0**31, 2.0**39, math.nextafter(2.0**29, math.inf), 2.0**-5, -3.0]
    for r in spark.createDataFrame([(v,) for v in floats], "v double").select("v", releases.power_rank(F.col("v"), False).alias("r")).collect():
        assert abs(r.v) <= 2.0**r.r and (r.r == -100 or abs(r.v) > 2.0 ** (r.r - 1))


def test_partition_selection(spark):
    one = SparkDataFrameDomain({"A": STR})
    m = releases.create_partition_selection_measurement(one, 1, "1/1000")
    e, d = m.privacy_function(1)
    assert e == 1 and d <= ExactNumber("1/1000")
    out = m(make(spark, [("big",)] * 500 + [("small",)], "A string"))
    assert "big" in {r.A for r in out.collect()}
    many = releases.create_partition_selection_measurement(one, 1, "1/1000", d_in=3)
    e, d = many.privacy_function(3)
    assert e <= 1 and d <= ExactNumber("1/1000")
    with pytest.raises(NotImplementedError):
        releases.create_partition_selection_measurement(one, 1, "1/1000", d_in="1/2")


def test_mechanisms(spark):
    assert noise.AddLaplaceNoise(NumpyIntegerDomain(), 2).privacy_function(3) == ExactNumber("3/2")
    assert noise.AddDiscreteGaussianNoise(2).privacy_function(3) == ExactNumber("9/4")
    assert noise.AddGeometricNoise(0)(np.int64(5)) == 5 and noise.AddGeometricNoise(0).privacy_function(1) == INFINITY
    assert math.isinf(noise.AddLaplaceNoise(NumpyFloatDomain(), INFINITY)(1.0))
    series = noise.AddNoiseToSeries(noise.AddGeometricNoise(1))
    m = noise.AddNoiseToColumn(AB, series, "B")
    first = m(make(spark, [("x", 100)] * 50))
    assert got(first) == got(first) and len({r.B for r in first.collect()}) > 3
    assert m.privacy_function(2) == 2
    shifted = [r.B for r in m(make(spark, [("x", 0)] * 4000)).collect()]
    assert abs(np.mean(shifted)) < 0.2 and abs(np.var(shifted) - 2 * math.exp(-1) / (1 - math.exp(-1)) ** 2) < 0.3


def test_converters_and_combinators():
    count = releases.create_count_measurement(AB, SD, PureDP(), 2, NoiseMechanism.GEOMETRIC)
    assert core.PureDPToRhoZCDP(count).privacy_function(1) == 2
    assert core.PureDPToApproxDP(count).privacy_function(1) == (2, 0)
    rho = releases.create_count_measurement(AB, SD, RhoZCDP(), "1/10", NoiseMechanism.DISCRETE_GAUSSIAN)
    approx = core.RhoZCDPToApproxDP(rho)
    need = 0.1 + 2 * math.sqrt(0.1 * math.log(1e6))
    assert approx.privacy_relation(1, (str(round(need + 1e-6, 8)), "1/1000000")) and not approx.privacy_relation(1, (str(round(need - 1e-6, 8)), "1/1000000"))
    assert core.Composition([count, count]).privacy_function(1) == 4
    assert (rows.Filter(AB, SD, "B > 1") | count).privacy_function(3) == 6
    with pytest.raises(errors.DomainMismatchError):
        rows.Select(AB, SD, ["A"]) | count
    with pytest.raises(errors.MeasureMismatchError):
        core.Composition([count, rho])
    assert core.UnwrapIfGroupedBy(AB, IfGroupedBy("A", RootSumOfSquared(SD))).stability_function(3) == 9


def test_dictionaries(spark):
    domain, metric = DictDomain({"t": AB}), AddRemoveKeys({"t": "A"})
    df = make(spark, [("x", 1), ("y", 2)])
    t = tables.FilterValue(domain, metric, "t", "u", "B > 1")
    assert t({"t": df})["u"].count() == 1 and t.output_metric == AddRemoveKeys({"t": "A", "u": "A"}) and t.stability_function(2) == 2
    assert tables.LimitKeysPerGroupValue(domain, metric, "t", "u", key_column="B", threshold=1)({"t": df})["u"].count() == 2
    assert tables.SelectValue(domain, metric, "t", "u", ["A"])({"t": df})["u"].columns == ["A"]
    with pytest.raises(ValueError):
        tables.TransformValue(domain, metric, rows.Identity if hasattr(rows, "Identity") else None, "t", "u")
    with pytest.raises(ValueError):
        tables.FilterValue(domain, metric, "t", "t", "B > 1")
    plain = DictMetric({"t": SD})
    c = tables.create_copy_and_transform_value(domain, plain, "t", "u", rows.Filter(AB, SD, "B > 1"), lambda a, b: a)
    assert sorted(c({"t": df})) == ["t", "u"] and c.stability_function({"t": 1}) == {"t": 1, "u": 1}
    made = tables.CreateDictFromValue(AB, IfGroupedBy("A", SD), "t", True)
    assert made.output_metric == metric and made(df) == {"t": df}
    assert tables.GetValue(domain, metric, "t").output_metric == IfGroupedBy("A", SD)
    assert tables.create_apply_dict_of_transformations({"a": rows.Select(AB, SD, ["A"]), "b": rows.Select(AB, SD, ["B"])}).stability_function(2) == {"a": 2, "b": 2}


def test_accountant(spark):
    df = make(spark, [("x", 1), ("x", 2), ("y", 3)])
    count = lambda budget: releases.create_count_measurement(AB, SD, PureDP(), budget, NoiseMechanism.GEOMETRIC)
    root = ia.PrivacyAccountant.launch(ia.SequentialComposition(AB, SD, PureDP(), 1, 6), df)
    root.measure(count(1))
    assert root.privacy_budget == PureDPBudget(5)
    parts = root.split(rows.PartitionByKeys(AB, SD, False, ["A"], [("x",), ("y",)]), 3)
    assert root.privacy_budget == PureDPBudget(2) and root.state is ia.PrivacyAccountantState.WAITING_FOR_CHILDREN
    assert [p.state for p in parts] == [ia.PrivacyAccountantState.ACTIVE, ia.PrivacyAccountantState.WAITING_FOR_SIBLING]
    parts[1].queue_transformation(rows.Filter(AB, SD, "B > 100"))
    for bad in (root, parts[1]):
        with pytest.raises(errors.InactiveAccountantError):
            bad.measure(count(1))
    parts[0].measure(count(2))
    with pytest.raises(errors.InsufficientBudgetError):
        parts[0].measure(count(2))
    parts[1].force_activate()
    assert parts[0].state is ia.PrivacyAccountantState.RETIRED and parts[1].state is ia.PrivacyAccountantState.ACTIVE
    parts[1].measure(count(3))
    parts[1].retire()
    assert root.state is ia.PrivacyAccountantState.ACTIVE
    root.measure(count(2))
    root.retire()
    with pytest.raises(errors.InactiveAccountantError):
        root.measure(count(0))


def test_queryables(spark):
    df = make(spark, [("x", 1)])
    exact = releases.create_count_measurement(AB, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC)
    adaptive = ia.create_adaptive_composition(AB, SD, 1, INFINITY, PureDP())
    ask = adaptive(df)
    assert ask(ia.MeasurementQuery(exact)) == 1 and adaptive.privacy_function(1) == INFINITY
    seq = ia.SequentialComposition(AB, SD, PureDP(), 1, 3)
    m = core.NonInteractivePostProcess(seq, lambda q: q(ia.MeasurementQuery(ia.MakeInteractive(releases.create_count_measurement(AB, SD, PureDP(), 3, NoiseMechanism.GEOMETRIC))))(None))
    assert isinstance(int(m(df)), int) and m.privacy_function(1) == 3
    q = ia.RetirableQueryable(seq(df))
    q(ia.RetireQuery())
    with pytest.raises(ValueError):
        q(ia.MeasurementQuery(exact))
    with pytest.raises(ValueError):
        ia.ParallelComposition(ListDomain(AB, 1), SumOf(SD), PureDP(), [exact])


def test_materialised_once(spark):
    from quietframe.sources import shared

    df = shared.sanitized(spark.range(20).select("id", F.rand().alias("r")))
    assert df.agg(F.sum("r")).first() == df.agg(F.sum("r")).first()
    odd = shared.get_materialized_df(spark.range(3).select(F.col("id").alias("a b.c")), "odd")
    assert odd.columns == ["a b.c"] and odd.count() == 3
    shared.cleanup(spark)
    assert shared.Config.temp_db_name() not in {d.name for d in spark.catalog.listDatabases()}
    assert shared.get_nonconflicting_string(["c0", "C1"]) == "c2"


def test_streaming_release(spark, tmp_path):
    from quietframe.streaming import windows

    source = tmp_path / "in"
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), k) for m in (1, 2, 3, 25, 50) for k in ("a", "b")], "ts timestamp, kind string").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(source))
    running = windows.collect(windows.windowed_counts(stream, "ts", ["kind"], "10 minutes", "5 minutes"), str(tmp_path / "closed"), str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    closed = spark.read.parquet(str(tmp_path / "closed"))
    zone = datetime.timezone.utc
    public = windows.public_windows(spark, datetime.datetime(2024, 1, 1, 0, 0, tzinfo=zone), datetime.datetime(2024, 1, 1, 0, 40, tzinfo=zone), datetime.timedelta(minutes=10))
    keys = make(spark, [("a",), ("b",), ("c",)], "kind string")
    found = {(w.start.minute, k): n for w, k, n in windows.release(closed, public, keys, PureDP(), INFINITY).collect()}
    assert len(found) == 12 and found[(0, "a")] == 3 and found[(20, "b")] == 1
    assert found[(0, "c")] == found[(10, "a")] == found[(30, "b")] == 0  # windows without rows appear all the same
    noisy = windows.release(closed, public, keys, PureDP(), 1)
    assert noisy.count() == 12


def test_sums_can_not_fail(spark):
    huge = make(spark, [(2**62,), (2**62,), (2**62,), (-5,)], "x long")
    domain = SparkDataFrameDomain({"x": SparkIntegerColumnDescriptor()})
    release = lambda low, high: releases.create_sum_measurement(domain, SymmetricDifference(), PureDP(), INFINITY, NoiseMechanism.GEOMETRIC, "x", low, high)(huge)
    assert release(0, 2**62) == 2**63 - 1  # the range's end
    assert release(-(2**40), 2**40) == 3 * 2**40 - 5
    assert release(-7, 3) == 4
    for low, high in ((-(2**62), 2**62), (0, 2**63)):
        with pytest.raises(ValueError):
            release(low, high)
    rng = random.Random(4)
    values = [rng.randrange(-(2**61), 2**61) for _ in range(40)]
    assert releases.create_sum_measurement(domain, SymmetricDifference(), PureDP(), INFINITY, NoiseMechanism.GEOMETRIC, "x", -(2**61), 2**61)(make(spark, [(v,) for v in values], "x long")) == sum(values)
    with pytest.raises(ValueError):
        releases.create_variance_measurement(domain, SymmetricDifference(), PureDP(), 1, NoiseMechanism.GEOMETRIC, "x", 0, 2**41)


@pytest.mark.parametrize("low,high", [(-6, 6), (0, 9), (4, 11), (-7, 2)])
@pytest.mark.parametrize("whole", [True, False])
def test_variance_is_centred(spark, low, high, whole):
    kind = SparkIntegerColumnDescriptor() if whole else SparkFloatColumnDescriptor()
    domain = SparkDataFrameDomain({"x": kind})
    noise = NoiseMechanism.GEOMETRIC if whole else NoiseMechanism.LAPLACE
    make_one = lambda budget: releases.create_variance_measurement(domain, SymmetricDifference(), PureDP(), budget, noise, "x", low, high)
    least = 0 if low <= 0 <= high else min(low * low, high * high)
    half = (max(low * low, high * high) - least) / 2
    assert abs(make_one(1).parts[1].sensitivity.to_float(True) - half) <= (0.5 if whole else 0)
    values = [low - 3, low, high, high + 9, (low + high) // 2, low + 1]
    clipped = [max(low, min(high, v)) for v in values]
    found = make_one(INFINITY)(make(spark, [(v if whole else float(v),) for v in values], "x long" if whole else "x double"))
    assert found == pytest.approx(statistics.variance(clipped))


def test_quantile_takes_values_with_counts():
    q = releases.NoisyQuantile(PandasSeriesDomain(NumpyFloatDomain()), PureDP(), 0.4, 0.0, 10.0, 3)
    values, counts = np.array([1.0, 2.0, 7.0, 12.0]), np.array([3, 1, 5, 2])
    free = releases.NoisyQuantile(PandasSeriesDomain(NumpyFloatDomain()), PureDP(), 0.4, 0.0, 10.0, INFINITY)
    assert free.interval(values, counts) == free.interval(np.repeat(values, counts)) == (2.0, 7.0)
    # the exponential mechanism by its definition: length times exp(-epsilon |rank - 0.4 n| / (2 max(0.4, 0.6)))
    edges, rank = [0, 1, 2, 7, 10], [0, 3, 4, 9]
    weight = [(b - a) * math.exp(-3 * abs(r - 0.4 * 11) / 1.2) for a, b, r in zip(edges, edges[1:], rank)]
    n = 4000
    found = Counter(q.interval(values, counts)[0] for _ in range(n))
    for a, w in zip(edges, weight):
        p = w / sum(weight)
        assert abs(found[float(a)] / n - p) < 6 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_gumbel_choice_with_weights_that_floats_can_not_tell():
    same = releases.LogWeights(np.array([0.0, 1.0]), np.array([1.0, 2.0]), [Fraction(10**15)] * 2, ExactNumber(1))
    found = Counter(releases.largest_gumbel(same) for _ in range(400))
    assert min(found[0], found[1]) > 120


def test_numbers_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(truncation, "COPIES", 7)
    df = spark.createDataFrame([("a", None)] * 30 + [("b", 1.0)] * 3 + [("c", float("nan"))], "k string, v double")
    rows = truncation.numbered(df, "n").collect()
    assert sorted(r.n for r in rows if r.k == "a") == list(range(1, 31)) and sorted(r.n for r in rows if r.k == "b") == [1, 2, 3] and len(rows) == 34


def test_small_properties():
    from quietframe.plans.domains import NumpyDomain

    assert [NumpyDomain.from_np_type(np.dtype(t)) for t in ("int8", "int16", "bool", "int32", "int64")] == [NumpyIntegerDomain(size=s) for s in (32, 32, 32, 32, 64)]
    with pytest.raises(ValueError):
        NumpyIntegerDomain(size=16)
    assert noise.AddLaplaceNoise.inverse_cdf(2.0, 0.5) == 0 and noise.AddLaplaceNoise.inverse_cdf(2.0, 0.9) == pytest.approx(-2 * math.log(0.2)) and noise.AddLaplaceNoise.inverse_cdf(2.0, 0.1) == pytest.approx(2 * math.log(0.2))
    assert noise.AddGaussianNoise.inverse_cdf(4.0, 0.975) == pytest.approx(2 * 1.959963985) and noise.AddGeometricNoise(0).adds_no_noise
    assert joins.PrivateJoin.truncation_strategy_stability(joins.TruncationStrategy.TRUNCATE, 5) == 2 and joins.PrivateJoin.truncation_strategy_stability(joins.TruncationStrategy.DROP, 5) == 5
    NoiseMechanism.LAPLACE.check_output_measure(PureDP())
    with pytest.raises(errors.UnsupportedMeasureError):
        NoiseMechanism.GAUSSIAN.check_output_measure(PureDP())
