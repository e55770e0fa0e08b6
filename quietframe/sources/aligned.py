"""Rows of two tables side by side, by their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietframe.sources.shared import in_place


def in_order(df: DataFrame, number: str) -> tuple[DataFrame, int]:
    """The table with each row's place in its order as a column, and how many rows it has.

    Places within partitions are counted where the rows are; how many rows earlier
    partitions have is a number a partition.
    """
    fixed = in_place(df).withColumn("__id", F.monotonically_increasing_id())  # the partition's number in the bits above 33
    part = F.shiftright("__id", 33)
    sizes = sorted((r["part"], r["count"]) for r in fixed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __start long"))
    place = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.withColumn("__part", part.cast("long")).join(known, "__part").select(*[F.col(f"`{c}`") for c in df.columns], place.alias(number)), total


def aligned(one: DataFrame, two: DataFrame) -> DataFrame | None:
    """Columns a and b of two tables of one column each, row by row; None if they have different numbers of rows."""
    (left, n), (right, m) = in_order(one.toDF("a"), "__at"), in_order(two.toDF("b"), "__at")
    return left.join(right, "__at").select("a", "b") if n == m else None
