"""The pipeline: contract of its stages and the whole against the operators' plain versions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quietframe.llm import quality
from quietframe.llm.queries import vocabulary
from tests.llm.test_jaccard_join import brute
from tests.llm.test_repeats import windows_gone

DIR = "/root/testdata/sf0.001"


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_stages_with_clashing_columns_null_ids_and_empty_tables(spark):
    """Columns that operators use inside pass through untouched; rows of null identifiers and texts are handled by every stage."""
    names = ["row", "k1", "k2", "sid", "score", "size", "token", "label", "first", "spans", "key", "w"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(i))
    odd = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    whole = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, whole, DIR)
        rows = out.collect()
        assert rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == whole.columns
            assert all(tuple(r[c] for c in names) == tuple(range(len(names))) for r in rows)
        assert stage(spark, whole.limit(0), DIR).collect() == []


def test_near_duplicates_keep_one(spark):
    from quietframe.llm import jaccard_join

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " x"), (9, "alone in the world of words"), (4, ""), (4, ""), (6, None), (3, text + " x"), (None, text)]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, size int")
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(3, text + " x"), (9, "alone in the world of words")]
    assert kept.where("coalesce(text, '') = ''").count() == 3


def test_whole_run(spark):
    from tokenizers import Tokenizer

    from quietframe.llm import decontamination

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in quality.keep(docs, model).select("doc_id", "text").collect()]
    stay = {c for _, _, c in brute(rows)}
    rows = [r for r in rows if r[0] in stay]
    texts = [t.encode() for _, t in rows]
    kept = []
    for (d, t), gone in zip(rows, windows_gone(texts, 200)):
        at, out = 0, []
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                out.append(c)
            at += size
        kept.append((d, "".join(out)))
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    bad = {r.doc_id for r in decontamination.contaminated(frame, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    coder = Tokenizer.from_file(vocabulary())
    want = []
    for d, t in kept:
        if d not in bad:
            ids = coder.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(want)
