"""Labelled documents and bounded samples of them, for the two trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the identifier as text, modulo 4, is 2 (null counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows that may be learnt from; of several labels of one document the smaller counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label and ``order`` of at most ``per_class`` documents of each label with texts of at most ``longest`` bytes, and how many documents each label has.

    The identifiers are drawn by hash from the labels alone, so at most
    ``2 * per_class`` rows are broadcast, and the documents are read once
    without a shuffle.
    """
    known = learnable(labels, label)
    counts = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    draw = lambda v: known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    rows = documents(docs).join(F.broadcast(draw(0).unionByName(draw(1))), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return rows.select("doc_id", "text", "label", F.xxhash64("doc_id").alias("order")), counts
