"""Spark plumbing of this subpackage: table access, checkpoints and partition counts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch of rows that goes to a Python worker; Spark's own limit is sixteen times as much, which both sides would hold several times.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The table, in a session that sends it to Python workers in batches of ``BATCH_BYTES`` (unless the user has set a limit)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared(spark: SparkSession) -> None:
    """Take the checkpoint folder that the cluster names; a local session without one gets a temporary folder, a cluster has to name it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quietframe-checkpoints"))


def folder(spark: SparkSession) -> str:
    """A new folder among the shared ones, for tables that one step writes and the next one reads."""
    shared(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that checkpoints have replaced: it does so only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``k1`` and ``k2``: two 64-bit hashes of a row's identifier and text, by which results find their row.

    Rows of one identifier and one text share a key and have one result; null
    counts as the smallest long and as the empty text.
    """
    both = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return [F.xxhash64(*both).alias("k1"), F.xxhash64(F.lit(0x5851F42D4C957F2D), *reversed(both)).alias("k2")]


KEY = ["k1", "k2"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, doc_id and text."""
    return small_batches(df).select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def with_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 and all columns of a row as the struct ``row``: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *row_key(id_col, text_col))


def with_hot_keys(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of rows with ``known``, which has one row for each key and how many rows the key has.

    Keys of more than a partition's share of the rows are at most as many as
    there are partitions; they are broadcast, and their rows stay where they are.
    """
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = known.where(F.col(count) > max(1000, total // partitions(rows.sparkSession))).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(known.drop(count), key, "left")
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under fixed names: other columns never get in the way."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
