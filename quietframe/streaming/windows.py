"""Noisy counts of event-time windows of a stream.

An extension.  The stream only collects: windows that the watermark has closed
are kept, as exact counts, in a folder that nobody reads but ``release``.  What is
released, and when, is fixed in public: a range of windows and a table of keys,
all of which appear with noise, whether rows fell into them or not.  Each window
is to be released once; its release spends its own budget (windows hold
different rows).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.functions.exact import ExactNumberInput
from quietframe.operators.grouped import GroupedDataFrame, named
from quietframe.operators.noise import NoiseMechanism, calculate_noise_scale, noisy
from quietframe.plans.measures import Measure
from quietframe.sources.shared import sanitized

#: Pairs of a window and a key that one release may have; they are broadcast at most.
MOST_CELLS = 10_000_000


def windowed_counts(events: DataFrame, time_column: str, keys: list[str], window: str, watermark: str) -> DataFrame:
    """Exact counts of windows and keys, given out when the watermark closes the window."""
    return events.withWatermark(time_column, watermark).groupBy(F.window(named(time_column), window).alias("window"), *map(named, keys)).agg(F.count(F.lit(1)).alias("count"))


def public_windows(spark: SparkSession, first: datetime.datetime, end: datetime.datetime, length: datetime.timedelta) -> DataFrame:
    """All windows from ``first`` up to ``end``, as the column ``window``."""
    if length <= datetime.timedelta(0) or end <= first:
        raise ValueError("The range of windows is empty.")
    seconds = F.lit(length.total_seconds())
    start = (F.lit(first.timestamp()) + F.col("id") * seconds).cast("timestamp")
    stop = (F.lit(first.timestamp()) + (F.col("id") + 1) * seconds).cast("timestamp")
    return spark.range(-(-(end - first) // length)).select(F.struct(start.alias("start"), stop.alias("end")).alias("window"))


def release(counts: DataFrame, windows: DataFrame, public_keys: DataFrame, output_measure: Measure, d_out: ExactNumberInput, mechanism: NoiseMechanism = NoiseMechanism.GEOMETRIC, d_in: ExactNumberInput = 1) -> DataFrame:
    """Every public key of every public window, with noise."""
    scale = calculate_noise_scale(d_in, d_out, output_measure)
    cells = windows.count() * public_keys.count()
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} pairs of a window and a key are too many for one release.")
    keys = windows.crossJoin(public_keys)  # both are public and small: their product was counted
    full = GroupedDataFrame(counts, keys).aggregate({"total": F.sum("count")}, {"total": 0})
    return sanitized(full.select("window", *map(named, public_keys.columns), noisy(F.col("total"), mechanism, scale).alias("count")))


def collect(counts: DataFrame, folder: str, checkpoint: str):
    """Keep the closed windows of a stream in a folder, as Parquet; private until ``release`` has read them."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()
