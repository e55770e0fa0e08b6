"""A corpus pipeline of five of the text operators; each stage writes a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quietframe.llm import bpe, decontamination, jaccard_join, quality, suffix_dedup
from quietframe.llm.frames import folder, read, remove
from quietframe.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest identifier."""
    return jaccard_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches of 200 bytes and more that occur elsewhere too."""
    return suffix_dedup.rewrite(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
#: Trained scores, suffix orders and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input goes when its output is written."""
    top, before = folder(spark), None
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
