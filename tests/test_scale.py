"""Operators that split hot groups: results against plain versions, and what plans and tasks hold."""

import hashlib
import math
import os
from collections import Counter
from fractions import Fraction
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quietframe.functions import batches, samplers
from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.operators import grouped, joins, laws, maps, per_record, quantiles, ranges, releases, rows, truncation
from quietframe.operators.noise import NoiseMechanism, noisy
from quietframe.plans import interactive as ia
from quietframe.plans.domains import ListDomain, NumpyFloatDomain, PandasDataFrameDomain, PandasSeriesDomain, SparkDataFrameDomain, SparkFloatColumnDescriptor, SparkIntegerColumnDescriptor, SparkRowDomain, SparkStringColumnDescriptor
from quietframe.plans.measures import PureDP
from quietframe.plans.metrics import AbsoluteDifference, IfGroupedBy, OnColumn, RootSumOfSquared, SumOf, SymmetricDifference
from quietframe.sources import shared

SD = SymmetricDifference()
KV = SparkDataFrameDomain({"k": SparkStringColumnDescriptor(allow_null=True), "v": SparkFloatColumnDescriptor()})
KX = SparkDataFrameDomain({"k": SparkStringColumnDescriptor(allow_null=True), "x": SparkIntegerColumnDescriptor()})


def single(values, quantile, lower, upper):
    return releases.NoisyQuantile(PandasSeriesDomain(NumpyFloatDomain()), PureDP(), quantile, lower, upper, INFINITY).interval(np.array(values, float))


def counted(spark, data):
    rows_ = [(k, float(v), n) for k, values in data.items() for v, n in Counter(min(max(v, 0.0), 100.0) for v in values).items()]
    return spark.createDataFrame(rows_, "k string, __value double, __n long")


@pytest.mark.parametrize("quantile", [0.0, 0.3, 0.5, 1.0])
def test_quantile_intervals_of_cut_groups(spark, quantile):
    draw = np.random.default_rng(int(quantile * 10))
    data = {"hot": draw.uniform(-5, 110, 4000).round(2).tolist(), None: [3.0, 3.0, 7.0], "few": [0.0, 100.0], "b": draw.integers(0, 9, 50).tolist(), "other": [1.0]}
    keys = spark.createDataFrame([("hot",), (None,), ("few",), ("b",), ("none",)], "k string")
    found = {r[0]: (r[1], r[2]) for r in quantiles.winning_intervals(counted(spark, data), keys, quantile, 0.0, 100.0, INFINITY).collect()}
    assert found == {k: single(data.get(k, []), quantile, 0.0, 100.0) for k in ("hot", None, "few", "b", "none")}


def test_noisy_intervals_of_a_cut_group_have_the_law_of_the_mechanism(spark):
    """One group over all partitions, drawn many times at once as groups of equal values."""
    values, epsilon, q, n = [10.0, 20.0, 70.0, 90.0], 1, 0.4, 3000
    edges, many = [0.0, *values, 100.0], 4
    weight = [(b - a) * math.exp(-epsilon * abs(r - q * many) / 1.2) for r, (a, b) in enumerate(zip(edges, edges[1:]))]
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), F.explode(F.array(*map(F.lit, values))).alias("__value"), F.lit(1).cast("long").alias("__n"))
    found = Counter(r["__low"] for r in quantiles.winning_intervals(df, spark.range(n).select(F.col("id").cast("string").alias("k")), q, 0.0, 100.0, ExactNumber(epsilon)).collect())
    for a, w in zip(edges, weight):
        p = w / sum(weight)
        assert abs(found[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_contenders_of_pieces_are_settled_together(spark):
    """One group in four pieces: the winner's law is that of the whole."""
    values = [float(v) for v in range(10, 90, 10)]
    df = spark.createDataFrame([("a", v, 1) for v in values], "k string, __value double, __n long")
    keys = spark.createDataFrame([("a",)], "k string")
    rank, n = range(len(values) + 1), 16
    weight = [10 * math.exp(-2 * abs(r - 4.0)) for r in rank]
    found = Counter(quantiles.winning_intervals(df, keys, 0.5, 0.0, 90.0, ExactNumber(2)).first()["__low"] for _ in range(n))
    assert max(found, key=found.get) == 40.0 and abs(found[40.0] / n - weight[4] / sum(weight)) < 0.45
    ordered = ranges.SortedGroups(df, ["k"], ["__value"], quantiles._summary)
    assert ordered.any_cut


def test_a_large_group_of_distinct_values_is_dealt_out(spark):
    n = 400_000
    df = spark.range(n).select(F.lit("all").alias("k"), (F.col("id") * 100.0 / n).alias("__value"), F.lit(1).cast("long").alias("__n"))
    ordered = ranges.SortedGroups(df, ["k"], ["__value"], quantiles._summary)
    sizes = [r["count"] for r in ordered.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * n / 4
    low, high = quantiles.winning_intervals(df, spark.createDataFrame([("all",)], "k string"), 0.75, 0.0, 100.0, INFINITY).first()[1:]
    assert low <= 75.0 <= high and high - low < 1e-3


def test_quantile_measurement_without_groups_and_with_equal_bounds(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(101)], "k string, v double")
    whole = releases.create_quantile_measurement(KV, SD, PureDP(), INFINITY, "v", 0.5, 0, 100)
    assert 49.0 <= whole(df) <= 52.0
    assert releases.create_quantile_measurement(KV, SD, PureDP(), 1, "v", 0.5, 7, 7)(df) == 7.0
    assert 0 <= releases.create_quantile_measurement(KV, SD, PureDP(), 1, "v", 0.5, 0, 100)(df.limit(0)) <= 100


GRID = SparkDataFrameDomain({"g": SparkStringColumnDescriptor(allow_null=True), "rank": SparkIntegerColumnDescriptor(), "n": SparkIntegerColumnDescriptor()})


def first_rank(counts, fraction):
    total, running = sum(counts), 0
    for rank, n in enumerate(counts):
        running += n
        if running >= int(total * fraction):
            return rank
    return len(counts) - 1


def test_prefix_sums_over_ranges(spark):
    draw = np.random.default_rng(2)
    data = {"hot": draw.integers(0, 5, 3000).tolist(), None: [1, 2, 3], "one": [0], "late": [0] * 300 + [9]}
    df = spark.createDataFrame([(g, r, int(n)) for g, counts in data.items() for r, n in enumerate(counts)], "g string, rank long, n long")
    m = releases.SparseVectorPrefixSums(GRID, "n", "rank", 0, ["g"], 0.9)
    assert {r["g"]: r["rank"] for r in m(df).collect()} == {g: first_rank(c, 0.9) for g, c in data.items()}
    whole = releases.SparseVectorPrefixSums(SparkDataFrameDomain({c: GRID[c] for c in ("rank", "n")}), "n", "rank", 0, None, 0.9)
    hot = df.where("g = 'hot'").select("rank", "n")
    assert whole(hot).first()["rank"] == first_rank(data["hot"], 0.9)
    plan = whole.passed(hot)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_prefix_sums_with_noise_use_one_limit_for_a_cut_group(spark):
    """With counts far above the noise all draws give the exact rank or a neighbour."""
    n = 2000
    df = spark.range(n).select(F.col("id").alias("rank"), F.lit(1000).cast("long").alias("n"))
    m = releases.SparseVectorPrefixSums(SparkDataFrameDomain({c: GRID[c] for c in ("rank", "n")}), "n", "rank", 5, None, 0.5)
    found = [m(df).collect() for _ in range(4)]
    assert all(len(f) == 1 and abs(f[0]["rank"] - (n // 2 - 1)) <= 1 for f in found)


def test_parts_by_key_from_one_scan(spark, tmp_path):
    source = str(tmp_path / "t")
    spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("x")).write.parquet(source)
    df, opened = spark.read.parquet(source), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            opened.add(b.num_rows)
            yield b

    values = [("hot",), (None,), ("absent",), ("3",)]
    with shared.keeping(spark) as folder:
        before = set(shared.Answers.known(spark))
        parts = rows.PartitionByKeys(KX, SD, False, ["k"], values)(df.mapInArrow(seen, df.schema))
        assert opened.value == 5000
        plain = lambda v: sorted(r["x"] for r in df.where(F.col("k").eqNullSafe(F.lit(v))).collect())
        assert [sorted(r["x"] for r in p.collect()) for p in parts] == [plain(v) for (v,) in values]
        assert opened.value == 5000 and all(p.columns == ["k", "x"] for p in parts)
        scan = parts[3]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(__part" in scan
        assert shared.files_under(spark, folder) > 0
        parts.release()
        assert set(shared.Answers.known(spark)) == before


@pytest.mark.parametrize("k", [3, 1200])
def test_limits_sort_numbers_and_the_whole_hash_decides_ties(spark, k):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    plan = truncation.truncate_large_groups(df, ["g"], k)._jdf.queryExecution().optimizedPlan().toString()
    limits = [line for line in plan.split("\n") if "WindowGroupLimit" in line]
    assert "__near" in plan and bool(limits) == (k < truncation.UNLIMITED) and not any("__hash" in line for line in limits[-1:])  # the lowest one gets all rows
    for head in ("", "0" * 15, "f" * 15):
        hashed = F.concat(F.lit(head), F.sha2(F.col("x").cast("string"), 256))
        found = [tuple(r) for r in truncation.lowest(df, [F.col("g")], hashed, [F.col("x")], k).collect()]
        digest = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
        want = [(g, x) for g in (0, 1) for x in sorted(range(g, 6000, 2), key=digest)[:k]]
        assert sorted(found) == sorted(want)


def test_rows_without_a_key_meet_in_several_tasks(spark, monkeypatch):
    """Where nulls are equal their pairs are dealt out on both sides; what few rows make stays with the rest."""
    monkeypatch.setattr(joins, "CELL", 50, raising=False)
    row = F.col("id")
    left = spark.range(1200).select(F.when(row % 3 > 0, row % 7).alias("k"), F.when(row % 4 > 0, row % 2).alias("j"), (row % 600).alias("a"))
    right = spark.range(700).select(F.when(row % 5 > 0, row % 9).alias("k"), F.when(row % 2 > 0, row % 4).alias("j"), (-row).alias("b"))
    for on, one, two in ((["k"], left.drop("j"), right.drop("j")), (["k", "j"], left, right)):
        for how in ("inner", "left", "right", "outer"):
            plain = one.alias("l").join(two.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]), "full" if how == "outer" else how)
            want = plain.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in on], "a", "b")
            found = joins.join(one, two, on, how, True)
            assert found.columns == want.columns
            assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect())), (on, how)
    met = joins.join(left.drop("j"), right.drop("j"), ["k"], "inner", True).where("k IS NULL")
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400 * 140 and max(tasks) < 400 * 140 / 4


def test_a_large_part_is_written_by_several_tasks(spark, monkeypatch):
    """However well its rows are packed: no file, and so no sort of a task, has more than about its share of rows."""
    monkeypatch.setattr(rows, "ROWS_A_TASK", 2000, raising=False)
    df = spark.range(21_000).select(F.when(F.col("id") < 20_000, "hot").otherwise((F.col("id") % 4).cast("string")).alias("k"), F.col("id").alias("x"))
    parts = rows.PartitionByKeys(KX, SD, False, ["k"], [("hot",), *[(str(i),) for i in range(4)], ("absent",)])(df)
    files = [[r["count"] for r in p.groupBy(F.input_file_name()).count().collect()] for p in parts]
    assert list(map(sum, files)) == [20_000, 250, 250, 250, 250, 0]
    assert len(files[0]) == 10 and max(files[0]) < 2500 and all(len(f) == 1 for f in files[1:5])
    parts.release()


def test_a_retired_accountant_leaves_no_parts_behind(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("x"))
    root = ia.PrivacyAccountant.launch(ia.SequentialComposition(KX, SD, PureDP(), 1, INFINITY), df)
    before = set(shared.Answers.known(spark))
    count = releases.create_count_measurement(KX, SD, PureDP(), INFINITY, NoiseMechanism.GEOMETRIC)
    found = []
    for child in root.split(rows.PartitionByKeys(KX, SD, False, ["k"], [("0",), ("1",), ("2",)]), INFINITY):
        found.append(int(child.measure(count)))
        child.retire()
    assert found == [100, 100, 100] and set(shared.Answers.known(spark)) - before
    root.retire()
    assert set(shared.Answers.known(spark)) == before


def test_keys_as_streams(spark):
    target = {"n": SparkIntegerColumnDescriptor(), "first": SparkIntegerColumnDescriptor()}

    def sums(rs):
        n = 0
        for r in rs:  # an iterator: nothing is held
            n += 1
            if r.x % 50_000 == 0:
                yield {"n": -1, "first": r.x}
        yield {"n": n, "first": 0}

    f = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(KX.schema)), ListDomain(SparkRowDomain(target)), sums, streaming=True)
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 < 8, "hot").otherwise("b").alias("k"), F.col("id").alias("x"))
    out = maps.FlatMapByKey(IfGroupedBy("k", SD), f)(df)
    got = {(r["k"], r["n"]) for r in out.where("n >= 0").collect()}
    assert got == {(None, 20_000), ("hot", 140_000), ("b", 40_000)} and out.where("n < 0").count() == 4
    as_list = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(KX.schema)), ListDomain(SparkRowDomain({"n": target["n"]})), lambda rs: [{"n": len(rs)}])
    assert {tuple(r) for r in maps.FlatMapByKey(IfGroupedBy("k", SD), as_list)(df).collect()} == got


class Total(releases.MergeableAggregate):
    """The sum and how many rows, of a series; without privacy, to show parts."""

    def __init__(self):
        super().__init__(PandasSeriesDomain(KX["x"].to_numpy_domain()), SD, PureDP(), StructType([StructField("x", LongType())]))

    def privacy_function(self, d_in):
        return INFINITY

    def init(self):
        return 0, 0

    def update(self, state, data):
        return state[0] + int(data.sum()), state[1] + len(data)

    def merge(self, state, other):
        return state[0] + other[0], state[1] + other[1]

    def finish(self, state):
        return state[0] * 1000 + state[1] % 1000


def test_aggregates_in_parts(spark, monkeypatch):
    monkeypatch.setattr(releases, "STATES", 2)
    df = spark.range(30_000).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 11)).alias("k"), F.col("id").alias("x"))
    keys = [("hot",), (None,), ("b3",), ("absent",)]
    group = grouped.create_groupby_from_list_of_keys(KX, SD, False, ["k"], keys)
    f = releases.AggregateByColumn(PandasDataFrameDomain({"x": PandasSeriesDomain(KX["x"].to_numpy_domain())}), {"x": Total()})
    assert f.is_mergeable
    found = {r["k"]: r["x"] for r in releases.ApplyInPandas(group.output_domain, SumOf(SD), f)(group(df)).collect()}
    whole = {r["k"]: r["s"] * 1000 + r["n"] % 1000 for r in df.groupBy("k").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()}
    assert found == {k: whole.get(k, 0) for (k,) in keys}
    states = releases.merged_states(group(df), f, f.output_schema)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in states


def test_columns_side_by_side(spark):
    n = 50_000
    one = spark.range(n).select((F.col("id") * 7 % 1000).alias("x"))
    two = spark.range(0, n, 1, 3).select((F.col("id") * 7 % 1000 + F.col("id") % 3).alias("x"))  # other partitions, the same order
    domain = SparkDataFrameDomain({"x": SparkIntegerColumnDescriptor()})
    far = sum(i % 3 for i in range(n))
    assert OnColumn("x", SumOf(AbsoluteDifference())).distance(one, two, domain) == far
    assert OnColumn("x", RootSumOfSquared(AbsoluteDifference())).distance(one, two, domain) ** 2 == sum((i % 3) ** 2 for i in range(n))
    assert OnColumn("x", SumOf(AbsoluteDifference())).distance(one, two.limit(n - 1), domain) == INFINITY
    floats = SparkDataFrameDomain({"x": SparkFloatColumnDescriptor()})
    a, b = spark.createDataFrame([(0.1,), (1e300,)], "x double"), spark.createDataFrame([(0.3,), (-1e300,)], "x double")
    assert OnColumn("x", SumOf(AbsoluteDifference())).distance(a, b, floats) == ExactNumber(Fraction(0.3) - Fraction(0.1) + 2 * Fraction(1e300))


def test_materialised_tables_go(spark, tmp_path):
    with shared.keeping(spark) as folder:
        before = shared.files_under(spark, folder)
        shared.get_materialized_df(spark.range(5).toDF("a b"))
        shared.sanitized(spark.range(5).select(F.rand().alias("r")))
        shared.in_place(spark.range(5).toDF("x"))
        known = shared.Answers.known(spark)
        assert all(shared.files_under(spark, p) for p in known[-3:]) and shared.files_under(spark, folder) > before
    assert not any(shared.files_under(spark, p) for p in known[-3:])
    dead = f"{shared.shared_folder(spark)}/quietframe_temp_1_{'0' * 32}_local-1"
    os.makedirs(dead)
    open(f"{dead}/left", "w").close()
    kept = f"{shared.shared_folder(spark)}/of-somebody-else"
    os.makedirs(kept, exist_ok=True)
    shared.remove_all_temp_tables(spark)
    assert not os.path.exists(dead) and os.path.exists(kept)
    empty = shared.get_materialized_df(spark.range(3).select())
    assert empty.count() == 3 and empty.columns == []
    shared.cleanup(spark)


def test_noise_is_written_before_it_is_moved(spark):
    """Where a task that has drawn noise is run again after a shuffle, rows of two draws would be mixed."""
    drawn = spark.range(40).select("id", noisy(F.lit(0), NoiseMechanism.GEOMETRIC, ExactNumber(1000)).alias("n"))
    assert not drawn._jdf.queryExecution().analyzed().deterministic()
    before = set(shared.Answers.known(spark))
    released = shared.sanitized(drawn)
    assert len(set(shared.Answers.known(spark)) - before) == 1  # the draw itself is removed
    assert released.count() == 40 and released.select("id").distinct().count() == 40
    assert "Python" not in released._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["laplace", "geometric", "discrete gaussian", "gaussian"])
def test_laws_tell_a_scale_that_is_five_per_cent_off(spark, kind):
    mechanism, scale, law, other = {
        "laplace": (NoiseMechanism.LAPLACE, 2, laws.laplace(2), laws.laplace(2.1)), "geometric": (NoiseMechanism.GEOMETRIC, 30, laws.geometric(30), laws.geometric(31.5)),
        "discrete gaussian": (NoiseMechanism.DISCRETE_GAUSSIAN, 40, laws.discrete_gaussian(1600), laws.discrete_gaussian(1764)), "gaussian": (NoiseMechanism.GAUSSIAN, 2, laws.gaussian(2), laws.gaussian(2.1)),
    }[kind]
    zero = F.lit(0).cast("long" if mechanism.integral else "double")
    drawn = spark.range(200_000).select(noisy(zero, mechanism, ExactNumber(scale)).alias("x")).persist()
    assert laws.fits(drawn, F.col("x"), law) and not laws.fits(drawn, F.col("x"), other)
    drawn.unpersist()


def test_bins_have_the_masses_of_their_law():
    for law in (laws.laplace(2), laws.gaussian(3), laws.geometric(5), laws.discrete_gaussian(7), laws.square_root_gaussian(2), laws.exponential_polylogarithmic(1, 1, 2)):
        assert sum(law.masses) == pytest.approx(1) and min(law.masses) > 0 and list(law.edges) == sorted(law.edges)
    assert laws.laplace(2).edges[7] == pytest.approx(0, abs=1e-12)
    exact = [1000 * m for m in laws.gaussian(1).masses]
    assert laws.statistic([round(x) for x in exact], laws.gaussian(1)) < 1 < laws.threshold(laws.gaussian(1))


@pytest.mark.parametrize("make, law, wrong", [
    (lambda n: batches.square_root_gaussian(n, 3.0), laws.square_root_gaussian(3.0), laws.square_root_gaussian(4.5)),
    (lambda n: batches.exponential_polylogarithmic(n, 1.0, 1.0, 2.0), laws.exponential_polylogarithmic(1.0, 1.0, 2.0), laws.exponential_polylogarithmic(1.0, 1.0, 3.0)),
    (lambda n: batches.exponential_polylogarithmic(n, 4.0, 2.0, 1.0), laws.exponential_polylogarithmic(4.0, 2.0, 1.0), laws.exponential_polylogarithmic(4.0, 2.0, 1.5)),
])
def test_batches_of_per_record_noise(make, law, wrong):
    found = np.histogram(make(8000), [-np.inf, *law.edges, np.inf])[0].tolist()
    assert laws.statistic(found, law) <= laws.threshold(law)
    found = np.histogram(make(8000), [-np.inf, *wrong.edges, np.inf])[0].tolist()
    assert laws.statistic(found, wrong) > laws.threshold(wrong)


def test_batches_agree_with_the_inverse_where_few_would_be_kept():
    values = batches.exponential_polylogarithmic(6, 30.0, 3.0, 1.0)  # hardly any normal number is beyond ln 3
    assert len(values) == 6 and np.isfinite(values).all() and np.abs(values).max() < 2


def test_per_record_columns(spark):
    df = spark.createDataFrame([(0.0,), (16.0,), (81.0,)], "x double")
    near = df.select("x", per_record.fourth_root_transformation(F.col("x"), 0.0, 1e-9).alias("a"), per_record.square_root_transformation(F.col("x"), 0.0, 1e-9).alias("b"), per_record.log_transformation(F.col("x"), 1.0, 1e-9).alias("c")).collect()
    assert all(abs(r[c] - r["x"]) < 1e-5 for r in near for c in "abc")
    with pytest.raises(Exception, match="has to be"):
        df.select(per_record.log_transformation(F.col("x"), 0.0, 1.0)).collect()


@pytest.mark.parametrize("nulls", [True, False])
@pytest.mark.parametrize("how", ["left", "right", "inner", "outer", "left_anti"])
def test_hot_keys_are_dealt_out(spark, monkeypatch, how, nulls):
    """Keys that are hot on the left, on the right, on both sides and nowhere, and null ones."""
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    left = [("hot", i) for i in range(90)] + [("both", i) for i in range(60)] + [("right", 1), ("left only", 2), (None, 3)] + [(None, 4)] * 40
    right = [("right", i) for i in range(80)] + [("both", i) for i in range(70)] + [("hot", 5), ("right only", 6), (None, 7)] + [("gone", i) for i in range(40)]
    one, two = spark.createDataFrame(left, "k string, a long"), spark.createDataFrame(right, "k string, b long")
    got = joins.join(one, two, ["k"], how, nulls, balanced=True)
    plain = joins.join(one, two, ["k"], how, nulls, balanced=False)
    assert got.columns == plain.columns and Counter(got.collect()) == Counter(plain.collect())


def test_a_key_with_half_of_the_rows(spark, monkeypatch):
    """An outer join whose largest task has about its share."""
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    n, settings = 120_000, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    one = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    two = spark.range(0, n, 3).select(F.col("id").alias("k"), F.col("id").alias("b"))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = joins.join(one, two, ["k"], "outer")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = joins.join(one, two, ["k"], "outer", balanced=False)
        alone = max(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
        assert joined.count() == plain.count() and max(sizes) < n / 4 < n / 2 <= alone
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_group_of_the_query_of_pandas_aggregates_is_held_whole(spark, monkeypatch):
    """Its aggregates are taken in parts; a frame of a whole group would not fit a task."""
    from quietframe import catalogue

    monkeypatch.setattr(grouped.GroupedDataFrame, "apply_in_pandas", lambda *_: pytest.fail("a group in one frame"))
    assert catalogue.queries()["apply_in_pandas"](spark, "/root/testdata/sf0.001").count() == 4


def test_few_draws_are_left_to_slow_arithmetic(monkeypatch):
    """Floats that 63 bits leave open are settled from 126, to the same floats as exact arithmetic gives from these bits."""
    settled, slow = [], []
    whole, refined = batches._settled, batches._refined

    def spy(out, places, bits, more, value):
        left = whole(out, places, bits, more, value)
        settled.extend((float(out[p]), int(bits[p]) << 63 | int(m), int(p)) for p, m in zip(places.tolist(), more.tolist()) if p not in dict(left))
        return left

    monkeypatch.setattr(batches, "_settled", spy)
    monkeypatch.setattr(batches, "_refined", lambda u, value: slow.append(u) or refined(u, value))
    center, n = np.random.default_rng(3).normal(0, 5, 5000), 5000
    batches.laplace(center, 3.0)
    assert settled and all(x == refined(batches.Open(b, 126), lambda p, c=float(center[i]): samplers.laplace_inverse_cdf(c, 3.0, p)) for x, b, i in settled[:200])
    batches.gaussian(center, Fraction(9))
    batches.square_root_gaussian(n, 2.0)
    batches.exponential_polylogarithmic(n, 1.0, 1.0, 2.0)
    assert len(slow) < 0.01 * 4 * n  # a few of a hundred before


def test_query_of_laws_keeps_no_draws(spark, monkeypatch):
    """Values are drawn and counted in one pass, by several tasks for a file of one row group."""
    from quietframe import catalogue

    monkeypatch.setattr(shared, "get_materialized_df", lambda *_: pytest.fail("draws are written"))
    assert catalogue.queries()["noise_laws"](spark, "/root/testdata/sf0.001").count() == 6
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert shared.spread(table, "l_orderkey").rdd.getNumPartitions() >= 16


def test_expensive_samplers_of_the_query_draw_in_batches(monkeypatch):
    """No draw of these goes through the arithmetic of single ones, but for a few of very many."""
    from quietframe import catalogue_numbers

    slow = []
    for name in ("geometric_exp", "discrete_laplace", "discrete_gaussian", "sample_dgauss", "construct_inverse_sampler"):
        monkeypatch.setattr(samplers, name, lambda *_, name=name: slow.append(name) or pytest.fail(name))
    for name in ("geometric_exp", "discrete_laplace", "discrete_gaussian", "laplace", "gaussian", "uniform"):
        draw, mean, variance = catalogue_numbers._SAMPLERS[name]
        x = np.asarray(draw(20_000), float)
        assert len(x) == 20_000 and abs(x.mean() - mean) < 6 * math.sqrt(variance / len(x)), name


def test_noise_of_scale_zero_takes_whole_batches(spark, monkeypatch):
    from quietframe import catalogue
    from quietframe.operators import noise

    built, init = [], noise._Mechanism.__init__
    monkeypatch.setattr(noise._Mechanism, "__init__", lambda self, *a: built.append(1) or init(self, *a))
    catalogue.queries()["noise_of_scale_zero"](spark, "/root/testdata/sf0.001")
    assert len(built) == 4  # once where the query is built, none a row


def test_domains_of_series_take_batches(spark, monkeypatch):
    """No frame is made for each customer."""
    from quietframe import catalogue

    plan = catalogue.queries()["domain_membership"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_custkey" in plan  # dealt out, not read by one task


def test_hot_keys_of_flat_maps_are_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(maps, "HOT_ROWS", 50)
    data = [(None, i) for i in range(60)] + [("hot", i) for i in range(100)] + [(str(i % 7), i) for i in range(70)]
    df = spark.createDataFrame(data, "k string, x long").repartition(3)
    f = maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(KX.schema)), ListDomain(SparkRowDomain({"n": SparkIntegerColumnDescriptor()})), lambda rs: [{"n": sum(r.x for r in rs)}], streaming=True)
    out = maps.FlatMapByKey(IfGroupedBy("k", SD), f)(df)
    want = Counter()
    for k, x in data:
        want[k] += x
    assert {r.k: r.n for r in out.collect()} == dict(want) and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.count("Sort [") <= 2


def test_columns_are_aligned_once(spark, monkeypatch):
    from quietframe.plans import metrics

    seen, whole = [], metrics.aligned
    monkeypatch.setattr(metrics, "aligned", lambda *two: seen.append(1) or whole(*two))
    domain = SparkDataFrameDomain({"x": SparkIntegerColumnDescriptor()})
    big = 2**62
    one, two = (spark.createDataFrame([(v,) for v in values], "x long") for values in ([1, 5, big, -3], [2, 3, -big, 9]))
    both = [OnColumn("x", m(AbsoluteDifference())) for m in (SumOf, RootSumOfSquared)]
    total, root = metrics.OnColumns(both).distance(one, two, domain)
    assert len(seen) == 1 and total == 15 + 2 * big and root * root == 1 + 4 + 4 * big * big + 144


def test_laws_are_counted_where_values_are_drawn(spark, monkeypatch):
    """One pass over the rows for all kinds, in pieces that no hot key gathers in one task; every row has its draws."""
    monkeypatch.setattr(laws, "PIECE", 100)
    law = laws.Law((0.5, 1.5, 2.5), (0.25,) * 4)
    kinds = [laws.Draws(lambda n: np.arange(n) % 4, 8, (law, laws.Law((1.5,), (0.5, 0.5)))), laws.Draws(lambda n: np.full(n, 2.5), 1, (law,))]
    hot = spark.range(20_000).select(F.lit(7).alias("k"))
    dealt, whole = [], laws.spread
    monkeypatch.setattr(laws, "spread", lambda df, *columns: dealt.append(whole(df, *columns)) or dealt[-1])
    assert laws.counts_of_draws(hot, ["k"], kinds) == [[[40_000] * 4, [80_000, 80_000]], [[0, 0, 0, 20_000]]]
    tasks = dealt[0].groupBy(F.spark_partition_id()).agg(F.sum("rows").alias("rows")).collect()
    assert len(tasks) > 8 and sum(r["rows"] for r in tasks) == 20_000 and max(r["rows"] for r in tasks) <= 4_000


def test_exponentials_of_pairs_are_as_exact_as_claimed(monkeypatch):
    """Few steps, of which the error is below the claimed one."""
    from decimal import Decimal, localcontext

    from quietframe.functions import pairs

    def number(p, i):
        x = sum(Fraction(*part[i].as_integer_ratio()) for part in p)
        return Decimal(x.numerator) / Decimal(x.denominator)

    high = np.concatenate([np.linspace(-40, 40, 400), np.linspace(-0.01, 0.01, 101), np.array([-9000.0, 700.3, 9000.0])]).astype(np.longdouble) / 3
    x = high, high * np.longdouble(2) ** -66
    steps, whole = [], pairs.multiply
    monkeypatch.setattr(pairs, "multiply", lambda *a: steps.append(1) or whole(*a))
    found = pairs.exp(x)
    assert len(steps) <= 4  # 21 before
    back = pairs.log(found)
    with localcontext() as c:
        c.prec = 60
        for i in range(len(high)):
            want, error = number(x, i), Decimal(Fraction(*pairs.ERROR.as_integer_ratio()).numerator) / Fraction(*pairs.ERROR.as_integer_ratio()).denominator
            assert abs(number(found, i) / want.exp() - 1) < error
            assert abs(number(back, i) - want) < error * max(1, abs(want))


def test_pairs_of_rows_without_a_key_are_kept_in_few_bytes(spark, monkeypatch, tmp_path):
    """They come in runs and short cycles, and a task has few enough of either side for dictionaries of its file."""
    left = spark.range(6000).select(F.lit(None).cast("long").alias("k"), F.xxhash64("id").alias("a"))
    right = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.xxhash64(-F.col("id")).alias("b"))
    joins.join(left, right, ["k"], "inner", True).write.parquet(str(tmp_path / "joined"))
    files = [f for f in (tmp_path / "joined").iterdir() if f.suffix == ".parquet"]
    found = spark.read.parquet(str(tmp_path / "joined"))
    assert found.agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b"), F.count("k")).first() == (18_000_000, 6000, 3000, 0)
    assert sum(f.stat().st_size for f in files) < 0.4 * 18_000_000
    monkeypatch.setattr(joins, "CELL", 40)
    monkeypatch.setattr(joins, "CELLS_A_TASK", 3, raising=False)
    small = joins.join(left.limit(400), right.limit(160), ["k"], "inner", True)
    tasks = small.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()
    assert sum(t["n"] for t in tasks) == 400 * 160 and len(tasks) > 40 and max(t["n"] for t in tasks) < 400 * 160 / 16


@pytest.mark.parametrize(("spread", "scale"), [(0.0, 3.0), (5.0, 3.0), (1e6, 1e-3)])
def test_draws_are_settled_in_pairs_of_floats(spread, scale):
    """Nearly all, and to the floats that exact arithmetic gives from the same bits, at the ends of the range as well."""
    n = 3000
    center, bits, more = np.random.default_rng(5).normal(0, 1, n) * spread, batches.random_bits(n), batches.random_bits(n)
    for first, step in ((0, 40), (2**62 - 20, 0), (2**62 - (20 << 30), 30), (2**63 - 1 - (39 << 35), 35)):
        bits[(step + 1) * 40 : (step + 1) * 40 + 40] = [first + (i << step) for i in range(40)]
    more[::7], more[::11] = 0, 2**63 - 1
    out, left = batches._laplace_in_floats(center, scale, bits, more)
    assert len(left) < 0.1 * n
    for i in sorted({*range(0, 1700), *range(1700, n, 20)} - set(left.tolist())):
        u = batches.Open(int(bits[i]) << 63 | int(more[i]), 126)
        assert out[i] == batches._refined(u, lambda p, c=float(center[i]): samplers.laplace_inverse_cdf(c, scale, p))
    sigma, sign = Fraction(10**7, 7), np.where(np.arange(n) % 2, 1.0, -1.0)
    whole = np.arange(n) % 9
    out, left = batches._gaussian_in_floats(center, sigma, whole, bits, sign)
    assert len(left) < 0.1 * n
    for i in set(range(n)) - set(left.tolist()):
        assert {float(Fraction(center[i]) + int(sign[i]) * sigma * (int(whole[i]) + f)) for f in batches.Open(int(bits[i])).ends()} == {out[i]}
