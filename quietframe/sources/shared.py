"""Reading tables, and writing releases once."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str, at_least: int = 0) -> DataFrame:
    """The rows dealt out by some columns to several tasks a core, for work that costs far more than moving them; a file is often read by one task."""
    tasks = max(at_least, 4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *columns)


#: Names of temporary databases, and how names of folders of materialised tables begin.
TEMPORARY = r"quietframe_temp_\d+_[0-9a-f]{32}"


class Config:
    """The database of temporary tables of this process."""

    _name = f"quietframe_temp_{int(time.time())}_{uuid.uuid4().hex}"

    @classmethod
    def temp_db_name(cls) -> str:
        return cls._name


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, a cluster has to name it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "quietframe-checkpoints")


def _hadoop(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def files_under(spark: SparkSession, path: str) -> int:
    """How many files a folder of any file system has, with those in its folders."""
    target, system = _hadoop(spark, path)
    if not system.exists(target):
        return 0
    found, n = system.listFiles(target, True), 0
    while found.hasNext():
        found.next()
        n += 1
    return n


class Answers:
    """The tables that this process has written, in a folder of its own for each session.

    A folder's name tells the process; ``cleanup`` and ``keeping`` remove what they
    wrote, ``remove_all_temp_tables`` also what dead processes have left.
    """

    _folders: ClassVar[dict[str, str]] = {}
    _written: ClassVar[dict[str, list[str]]] = {}

    @classmethod
    def folder(cls, spark: SparkSession) -> str:
        """The folder of this session's tables."""
        app = spark.sparkContext.applicationId
        if app not in cls._folders:
            cls._folders[app] = f"{shared_folder(spark)}/{Config.temp_db_name()}_{re.sub(r'[^0-9A-Za-z]', '-', app)}"
            cls._written[app] = []
        return cls._folders[app]

    @classmethod
    def new(cls, spark: SparkSession) -> str:
        """A path for one more table."""
        path = f"{cls.folder(spark)}/{uuid.uuid4().hex}"
        cls._written[spark.sparkContext.applicationId].append(path)
        return path

    @classmethod
    def note(cls, spark: SparkSession, path: str) -> None:
        """Remember a path that was written elsewhere."""
        cls.folder(spark)
        cls._written[spark.sparkContext.applicationId].append(path)

    @classmethod
    def known(cls, spark: SparkSession) -> list[str]:
        """The paths that are still there."""
        return list(cls._written.get(spark.sparkContext.applicationId, []))

    @classmethod
    def remove(cls, spark: SparkSession, paths: Iterable[str]) -> None:
        """Delete tables; what is gone already is no error."""
        own = cls._written.get(spark.sparkContext.applicationId, [])
        for path in list(paths):
            target, system = _hadoop(spark, path)
            system.delete(target, True)
            if path in own:
                own.remove(path)


def get_materialized_df(sdf: DataFrame, table_name: str | None = None) -> DataFrame:
    """Evaluate a table once and for all.

    The rows are written to the shared folder, where a lost executor neither loses
    nor redraws them, and stay until ``cleanup``.  With a name they are saved as a
    table of the temporary database instead.  Columns are renamed to numbers in
    either case, which any format can hold.
    """
    spark = sdf.sparkSession
    plain = sdf.toDF(*map(str, range(len(sdf.columns))))
    if table_name is None:
        path = Answers.new(spark)
        if not sdf.columns:
            sdf.select(F.lit(True).alias("0")).write.parquet(path)
            return spark.read.schema("`0` boolean").parquet(path).select()
        plain.write.parquet(path)
        return spark.read.schema(plain.schema).parquet(path).toDF(*sdf.columns)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{Config.temp_db_name()}`")
    full = f"`{Config.temp_db_name()}`.`{table_name}`"
    plain.write.mode("errorifexists").saveAsTable(full)
    return spark.read.table(full).toDF(*sdf.columns)


def in_place(sdf: DataFrame) -> DataFrame:
    """Evaluate a table once, with its partitions and the order inside them as they are; it goes with the other tables."""
    spark = sdf.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(Answers.folder(spark))
    out = sdf.checkpoint(eager=True)
    written = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        Answers.note(spark, written.get())
    return out


def sanitized(sdf: DataFrame) -> DataFrame:
    """A release: rows in random places, sorted inside partitions, evaluated once.

    Where rows come from and in which order must not tell anything beyond the rows.
    Noise is written before anything is moved: a task of a shuffle that is run
    again would draw it anew, and rows of two draws would be mixed.
    """
    spark, drawn = sdf.sparkSession, None
    if not sdf._jdf.queryExecution().analyzed().deterministic():
        before = set(Answers.known(spark))
        sdf = get_materialized_df(sdf)
        drawn = set(Answers.known(spark)) - before
    mixed = sdf.repartition(F.rand())
    out = get_materialized_df(mixed.sortWithinPartitions(*[F.col(f"`{c}`") for c in sdf.columns]) if sdf.columns else mixed)
    if drawn:
        Answers.remove(spark, drawn)
    return out


@contextmanager
def keeping(spark: SparkSession) -> Iterator[str]:
    """What is materialised inside goes at the end; gives the folder it is written to."""
    before = set(Answers.known(spark))
    try:
        yield Answers.folder(spark)
    finally:
        Answers.remove(spark, [p for p in Answers.known(spark) if p not in before])


def cleanup(spark: SparkSession | None = None) -> None:
    """Drop this process's temporary database and remove all tables that it has materialised."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.sql(f"DROP DATABASE IF EXISTS `{Config.temp_db_name()}` CASCADE")
        Answers.remove(spark, Answers.known(spark))
        if not files_under(spark, Answers.folder(spark)):  # others may have put their checkpoints there
            target, system = _hadoop(spark, Answers.folder(spark))
            system.delete(target, True)


def remove_all_temp_tables(spark: SparkSession | None = None) -> None:
    """Drop the temporary databases and remove the materialised tables of all processes, dead ones included."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for db in spark.catalog.listDatabases():
        if re.fullmatch(TEMPORARY, db.name):
            spark.sql(f"DROP DATABASE `{db.name}` CASCADE")
    top, system = _hadoop(spark, shared_folder(spark))
    for status in system.listStatus(top) if system.exists(top) else []:
        if re.fullmatch(rf"{TEMPORARY}_[0-9A-Za-z-]+", status.getPath().getName()):
            system.delete(status.getPath(), True)
    Answers._written.pop(spark.sparkContext.applicationId, None)
    Answers._folders.pop(spark.sparkContext.applicationId, None)


@atexit.register
def _at_exit() -> None:
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        try:
            cleanup(session)
        except Exception:  # the session may be stopping
            return


def print_sdf(sdf: DataFrame) -> None:
    """Print a small table in a fixed order."""
    print(sdf.orderBy(*[F.col(f"`{c}`") for c in sdf.columns]).toPandas() if sdf.columns else sdf.toPandas())


def get_nonconflicting_string(strs: list[str]) -> str:
    """A name that no name in the list equals, whatever the case."""
    taken, n = {s.lower() for s in strs}, 0
    while f"c{n}" in taken:
        n += 1
    return f"c{n}"


def escape_column_name(column_name: str) -> str:
    return f"`{column_name.replace('`', '``')}`"
