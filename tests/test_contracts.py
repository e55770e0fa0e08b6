"""The contract matrix: neighbouring tables of every metric go through every operator, and what comes out is no further apart than its stability says.

Tables are parts of the driver's; neighbours are drawn at random: some rows, or
all rows of some keys, or values in place, are added, removed or changed.
"""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.operators import grouped, joins, maps, rows, tables, truncation
from quietframe.plans.core import HammingDistanceToSymmetricDifference, Identity, UnwrapIfGroupedBy
from quietframe.plans.domains import DictDomain, ListDomain, SparkDataFrameDomain, SparkIntegerColumnDescriptor, SparkRowDomain, SparkStringColumnDescriptor
from quietframe.plans.metrics import AddRemoveKeys, DictMetric, HammingDistance, IfGroupedBy, RootSumOfSquared, SumOf, SymmetricDifference

SD, HD = SymmetricDifference(), HammingDistance()
DOMAIN = SparkDataFrameDomain({"k": SparkIntegerColumnDescriptor(), "f": SparkStringColumnDescriptor(), "x": SparkIntegerColumnDescriptor()})
SCHEMA = StructType([StructField("k", LongType(), False), StructField("f", StringType(), False), StructField("x", LongType(), False)])
KEYS = {"k": list(range(8)), "f": ["A", "N", "R"]}


@pytest.fixture(scope="module")
def lines(spark):
    """Some lines of orders: key, flag and number."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 40")
    return [(r[0], r[1], r[2]) for r in df.select((F.col("l_orderkey") % 8).cast("long"), "l_returnflag", F.col("l_linenumber").cast("long")).collect()]


def new_row(draw):
    return draw.randrange(8), draw.choice("ANR"), draw.randrange(1, 8)


def neighbours(kind, data, draw):
    """Two lists of rows that differ in the way that a metric counts."""
    one = draw.sample(data, 40)
    two = list(one)
    if kind == "rows":  # added and removed
        for _ in range(draw.randint(1, 3)):
            two.pop(draw.randrange(len(two))) if draw.random() < 0.5 else two.append(new_row(draw))
    elif kind == "changed":
        for i in draw.sample(range(len(two)), draw.randint(1, 3)):
            two[i] = new_row(draw)
    else:  # all rows of a value of a column
        column = {"k": 0, "f": 1}[kind]
        for value in draw.sample(KEYS[kind], draw.randint(1, 2)):
            rest = [r for r in two if r[column] != value]
            new = [tuple(value if i == column else c for i, c in enumerate(new_row(draw))) for _ in range(draw.randint(0, 4))]
            two = rest + (new if draw.random() < 0.7 else [])
    draw.shuffle(two)
    return one, two


def whole(n):
    return ExactNumber(n) if not isinstance(n, ExactNumber) else n


def held(spark, t, kind, lines, seed, measured=None):
    """Neighbours through the transformation."""
    draw = random.Random(seed)
    for _ in range(1):
        one, two = (spark.createDataFrame(v, SCHEMA) for v in neighbours(kind, lines, draw))
        d_in = t.input_metric.distance(one, two, t.input_domain)
        a, b = t(one), t(two)
        d_out = (measured or (lambda m, x, y, d: m.distance(x, y, d)))(t.output_metric, a, b, t.output_domain)
        limit = t.stability_function(d_in)
        assert whole(d_out) <= whole(limit), (t, d_in, d_out, limit)
        assert t.stability_relation(d_in, limit)


IGB = {
    "SD": lambda c: IfGroupedBy(c, SD), "Sum": lambda c: IfGroupedBy(c, SumOf(SD)), "Root": lambda c: IfGroupedBy(c, RootSumOfSquared(SD)),
}
#: Metrics over rows, with the neighbours that they are for.
METRICS = {"SD": (SD, "rows"), "HD": (HD, "changed"), "k SD": (IGB["SD"]("k"), "k"), "k Sum": (IGB["Sum"]("k"), "rows"), "k Root": (IGB["Root"]("k"), "rows")}
PARTS = ListDomain(SparkRowDomain(DOMAIN.schema | {"y": SparkIntegerColumnDescriptor()}))


def more(row):
    return [{"y": i} for i in range(row.x % 3)]


def _public(spark):
    return spark.createDataFrame([("A", 1), ("A", 2), ("N", 3)], "f string, z long")


OPERATORS = {
    "Filter": (lambda m, s: rows.Filter(DOMAIN, m, "x > 2"), "SD,k SD,k Sum,k Root"),
    "Select": (lambda m, s: rows.Select(DOMAIN, m, ["k", "x"]), "SD,HD,k SD,k Sum,k Root"),
    "Rename": (lambda m, s: rows.Rename(DOMAIN, m, {"x": "w"}), "SD,HD,k SD,k Sum,k Root"),
    "Map": (lambda m, s: maps.Map(m, maps.RowToRowTransformation(SparkRowDomain(DOMAIN.schema), SparkRowDomain(DOMAIN.schema | {"y": SparkIntegerColumnDescriptor()}), lambda r: {"y": r.x * 2}, True)), "SD,HD,k SD,k Sum,k Root"),
    "FlatMap": (lambda m, s: maps.FlatMap(m, maps.RowToRowsTransformation(SparkRowDomain(DOMAIN.schema), PARTS, more, True), 2), "SD,k SD,k Sum,k Root"),
    "PublicJoin": (lambda m, s: joins.PublicJoin(DOMAIN, m, _public(s)), "SD,k SD,k Sum,k Root"),
    "PublicJoin left": (lambda m, s: joins.PublicJoin(DOMAIN, m, _public(s), how="left"), "SD,k SD,k Sum,k Root"),
    "Identity": (lambda m, s: Identity(m, DOMAIN), "SD,HD,k SD"),
    "AddUniqueColumn": (lambda m, s: rows.AddUniqueColumn(DOMAIN, "id"), "SD"),
    "HammingDistanceToSymmetricDifference": (lambda m, s: HammingDistanceToSymmetricDifference(DOMAIN), "HD"),
    "UnwrapIfGroupedBy": (lambda m, s: UnwrapIfGroupedBy(DOMAIN, m), "k Sum,k Root"),
    "FlatMapByKey": (lambda m, s: maps.FlatMapByKey(m, maps.RowsToRowsTransformation(ListDomain(SparkRowDomain(DOMAIN.schema)), ListDomain(SparkRowDomain({"n": SparkIntegerColumnDescriptor()})), lambda rs: [{"n": len(rs)}] * (len(rs) % 3))), "k SD"),
    "LimitRowsPerGroup": (lambda m, s: truncation.LimitRowsPerGroup(DOMAIN, SD, "k", 2), "k SD"),
    "LimitRowsPerGroup same": (lambda m, s: truncation.LimitRowsPerGroup(DOMAIN, IGB["SD"]("k"), "k", 2), "k SD"),
    "LimitKeysPerGroup Sum": (lambda m, s: truncation.LimitKeysPerGroup(DOMAIN, IfGroupedBy("f", SumOf(IGB["SD"]("k"))), "k", "f", 2), "k SD"),
    "LimitKeysPerGroup Root": (lambda m, s: truncation.LimitKeysPerGroup(DOMAIN, IfGroupedBy("f", RootSumOfSquared(IGB["SD"]("k"))), "k", "f", 2), "k SD"),
    "LimitKeysPerGroup same": (lambda m, s: truncation.LimitKeysPerGroup(DOMAIN, IGB["SD"]("k"), "k", "f", 2), "k SD"),
    "LimitRowsPerKeyPerGroup same": (lambda m, s: truncation.LimitRowsPerKeyPerGroup(DOMAIN, IGB["SD"]("k"), "k", "f", 1), "k SD"),
}


@pytest.mark.parametrize("name, metric", [(n, m) for n, (_, ms) in OPERATORS.items() for m in ms.split(",")])
def test_tables_stay_as_near_as_is_said(spark, lines, name, metric):
    t = OPERATORS[name][0](METRICS[metric][0], spark)
    held(spark, t, METRICS[metric][1], lines, f"{name} {metric}")


@pytest.mark.parametrize("name, metric", [("Filter", "HD"), ("FlatMap", "HD"), ("PublicJoin", "HD")])
def test_metrics_that_an_operator_refuses(spark, name, metric):
    with pytest.raises(Exception, match="supported|Metric|metric"):
        OPERATORS[name][0](METRICS[metric][0], spark)


@pytest.mark.parametrize("aggregate", [SumOf, RootSumOfSquared])
def test_limited_rows_of_keys_and_groups(spark, lines, aggregate):
    """From groups of keys to rows: at most so many rows of a key and group change."""
    inner = IfGroupedBy("f", aggregate(IGB["SD"]("k")))
    t = truncation.LimitRowsPerKeyPerGroup(DOMAIN, inner, "k", "f", 2)
    assert t.output_metric == (SD if aggregate is SumOf else IfGroupedBy("f", RootSumOfSquared(SD)))
    held(spark, t, "k", lines, f"limited {aggregate.__name__}")


@pytest.mark.parametrize("root", [False, True])
def test_grouping_flat_map(spark, lines, root):
    row = maps.RowToRowsTransformation(SparkRowDomain(DOMAIN.schema), PARTS, more, True)
    held(spark, maps.GroupingFlatMap((RootSumOfSquared if root else SumOf)(SD), row, 2), "rows", lines, f"grouping {root}")


@pytest.mark.parametrize("metric", ["SD", "f Sum", "f Root", "k Sum"])
def test_partition_by_keys(spark, lines, metric):
    """Rows add up over the parts."""
    given, root = {"SD": (SD, False), "f Sum": (IGB["Sum"]("f"), False), "f Root": (IGB["Root"]("f"), True), "k Sum": (IGB["Sum"]("k"), False)}[metric]
    held(spark, rows.PartitionByKeys(DOMAIN, given, root, ["f"], [("A",), ("N",)]), "rows", lines, f"parts {metric}")


@pytest.mark.parametrize("metric, root", [("SD", False), ("SD", True), ("HD", False), ("HD", True), ("k Sum", False), ("k Root", True)])
def test_groups_and_grouped_aggregates(spark, lines, metric, root):
    given, kind = METRICS[metric]
    group = grouped.create_groupby_from_list_of_keys(DOMAIN, given, root, ["k"], [(k,) for k in range(8)])
    held(spark, group, kind, lines, f"groups {metric} {root}")
    ordered = lambda m, a, b, d: m.distance(a.orderBy("k").coalesce(1), b.orderBy("k").coalesce(1), d)
    inside = group.output_domain, group.output_metric
    for t in (grouped.CountGrouped(*inside), grouped.CountDistinctGrouped(*inside), grouped.SumGrouped(*inside, "x", -3, 5)):
        held(spark, group | t, kind, lines, f"aggregates {metric} {root}", ordered)


@pytest.mark.parametrize("metric", ["SD", "HD"])
def test_plain_aggregates(spark, lines, metric):
    given, kind = METRICS[metric]
    for t in (grouped.Count(DOMAIN, given), grouped.CountDistinct(DOMAIN, given), grouped.Sum(DOMAIN, given, "x", 2, 6)):
        held(spark, t, kind, lines, f"plain {metric}")


@pytest.mark.parametrize("left, right", [(joins.TruncationStrategy.TRUNCATE, joins.TruncationStrategy.TRUNCATE), (joins.TruncationStrategy.DROP, joins.TruncationStrategy.TRUNCATE), (joins.TruncationStrategy.DROP, joins.TruncationStrategy.DROP)])
def test_private_join(spark, lines, left, right):
    other = SparkDataFrameDomain({"k": SparkIntegerColumnDescriptor(), "z": SparkIntegerColumnDescriptor()})
    domain = DictDomain({"l": DOMAIN, "r": other})
    t = joins.PrivateJoin(domain, "l", "r", left, right, 2, 3)
    metric, draw = DictMetric({"l": SD, "r": SD}), random.Random(str((left, right)))
    for _ in range(2):
        one, two = (spark.createDataFrame(v, SCHEMA) for v in neighbours("rows", lines, draw))
        far, near = (spark.createDataFrame(v, SCHEMA).select("k", F.col("x").alias("z")) for v in neighbours("rows", lines, draw))
        a, b = {"l": one, "r": far}, {"l": two, "r": near}
        d_in = metric.distance(a, b, domain)
        assert t.output_metric.distance(t(a), t(b), t.output_domain) <= t.stability_function(d_in)


def test_private_join_on_key_and_values_of_dictionaries(spark, lines):
    other = SparkDataFrameDomain({"k": SparkIntegerColumnDescriptor(), "z": SparkIntegerColumnDescriptor()})
    domain, metric, draw = DictDomain({"l": DOMAIN, "r": other}), AddRemoveKeys({"l": "k", "r": "k"}), random.Random(4)
    flat = maps.RowToRowsTransformation(SparkRowDomain(DOMAIN.schema), PARTS, more, True)
    kinds = [
        joins.PrivateJoinOnKey(domain, metric, "l", "r", "new"), tables.FilterValue(domain, metric, "l", "new", "x > 2"), tables.SelectValue(domain, metric, "l", "new", ["k", "x"]),
        tables.LimitRowsPerGroupValue(domain, metric, "l", "new", 2), tables.FlatMapValue(domain, metric, "l", "new", flat, 2), tables.PublicJoinValue(domain, metric, "l", "new", _public(spark)),
    ]
    for t in kinds:
        one, two = neighbours("k", lines, draw)
        changed = {r[0] for r in one if one.count(r) != two.count(r)} | {r[0] for r in two if one.count(r) != two.count(r)}
        table = lambda v: spark.createDataFrame(v, SCHEMA)
        far = [r for r in lines if r[0] not in changed]  # a key comes and goes in all tables
        a, b = ({"l": table(v), "r": table(far).select("k", F.col("x").alias("z"))} for v in (one, two))
        d_in = metric.distance(a, b, domain)
        d_out = t.output_metric.distance(t(a), t(b), t.output_domain)
        assert d_in != INFINITY and d_out <= t.stability_function(d_in), (t, d_in, d_out)
