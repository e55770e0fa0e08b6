"""Time inputs of the shapes that scripts for libraries of this kind use; prints a Markdown table.

BENCH_CPUS: cores.  Each shape is run twice and the second run is shown; answers
are read whole.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quietframe.functions.exact import ExactNumber
from quietframe.operators import grouped, joins, maps, noise, releases
from quietframe.operators.noise import NoiseMechanism
from quietframe.plans.domains import DictDomain, ListDomain, SparkDataFrameDomain, SparkIntegerColumnDescriptor, SparkRowDomain
from quietframe.plans.measures import PureDP
from quietframe.plans.metrics import SymmetricDifference

SD = SymmetricDifference()
AX = SparkDataFrameDomain({"A": SparkIntegerColumnDescriptor(), "X": SparkIntegerColumnDescriptor()})


def rows_in_groups(spark, groups: int, size: int):
    return spark.range(groups * size).select((F.col("id") % groups).alias("A"), (F.col("id") % 7).alias("X"))


def keys(spark, groups: int):
    return grouped.GroupBy(AX, SD, False, spark.range(groups).select(F.col("id").alias("A")))


def counted(spark, groups: int, size: int):
    return releases.create_count_measurement(AX, SD, PureDP(), 1, NoiseMechanism.GEOMETRIC, groupby_transformation=keys(spark, groups))(rows_in_groups(spark, groups, size))


def summed(spark, groups: int, size: int):
    return releases.create_sum_measurement(AX, SD, PureDP(), 1, NoiseMechanism.GEOMETRIC, "X", 0, 7, groupby_transformation=keys(spark, groups))(rows_in_groups(spark, groups, size))


def quantiles(spark, groups: int, size: int):
    return releases.create_quantile_measurement(AX, SD, PureDP(), 1, "X", 0.5, 0, 10, groupby_transformation=keys(spark, groups))(rows_in_groups(spark, groups, size))


def distinct_quantile(spark, n: int):
    domain = SparkDataFrameDomain({"X": SparkIntegerColumnDescriptor()})
    m = releases.create_quantile_measurement(domain, SD, PureDP(), 1, "X", 0.5, 0, n)
    return spark.createDataFrame([(float(m(spark.range(n).select(F.col("id").alias("X")))),)], "q double")


def noise_on(spark, kind: NoiseMechanism, n: int):
    return spark.range(n).select(noise.noisy(F.lit(0), kind, ExactNumber(3)).alias("x"))


def mapped(spark, n: int):
    domain = SparkRowDomain(AX.schema)
    f = maps.RowToRowTransformation(domain, SparkRowDomain({"Y": SparkIntegerColumnDescriptor()}), lambda r: {"Y": r.A + r.X})
    return maps.Map(SD, f)(rows_in_groups(spark, n, 1))


def flat_mapped(spark, n: int, times: int):
    f = maps.RowToRowsTransformation(SparkRowDomain(AX.schema), ListDomain(SparkRowDomain({"Y": SparkIntegerColumnDescriptor()})), lambda r: [{"Y": r.A + i} for i in range(times)])
    return maps.FlatMap(SD, f, times)(rows_in_groups(spark, n, 1))


def publicly_joined(spark, n: int):
    public = spark.range(1000).select(F.col("id").alias("A"), (F.col("id") * 2).alias("P"))
    return joins.PublicJoin(AX, SD, public, public_df_domain=SparkDataFrameDomain({"A": SparkIntegerColumnDescriptor(), "P": SparkIntegerColumnDescriptor()}))(rows_in_groups(spark, 1000, n // 1000))


def privately_joined(spark, groups: int, size: int):
    other = SparkDataFrameDomain({"A": SparkIntegerColumnDescriptor(), "Z": SparkIntegerColumnDescriptor()})
    left, right = rows_in_groups(spark, groups, size), rows_in_groups(spark, groups, size).withColumnRenamed("X", "Z")
    cut = joins.TruncationStrategy.TRUNCATE
    return joins.PrivateJoin(DictDomain({"l": AX, "r": other}), "l", "r", cut, cut, 2, 2)({"l": left, "r": right})


SHAPES = {
    "count, 640,000 groups of 1 row": lambda s: counted(s, 640_000, 1), "count, 100 groups of 100,000 rows": lambda s: counted(s, 100, 100_000), "sum, 640,000 groups of 1 row": lambda s: summed(s, 640_000, 1), "sum, 100 groups of 100,000 rows": lambda s: summed(s, 100, 100_000),
    "quantile, 10,000 groups of 100 rows": lambda s: quantiles(s, 10_000, 100), "quantile, 1 group of 10,000,000 rows": lambda s: quantiles(s, 1, 10_000_000), "quantile, 10,000,000 distinct values": lambda s: distinct_quantile(s, 10_000_000),
    **{f"{k.name.lower()} noise on 640,000 zeros": lambda s, k=k: noise_on(s, k, 640_000) for k in NoiseMechanism},
    "map in Python, 320,000 rows": lambda s: mapped(s, 320_000), "flat map in Python, 100,000 rows by 10": lambda s: flat_mapped(s, 100_000, 10), "public join, 10,000,000 rows": lambda s: publicly_joined(s, 10_000_000), "private join, 100,000 groups of 10 rows": lambda s: privately_joined(s, 100_000, 10),
}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(f"| shape | seconds, {cpus} cores |\n|-|-|")
    for name, shape in SHAPES.items():
        for _ in range(2):
            start = time.perf_counter()
            shape(spark).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        print(f"| {name} | {took:.2f} |", flush=True)


if __name__ == "__main__":
    main()
