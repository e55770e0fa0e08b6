"""Quality and toxicity on held-out labels, and their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietframe.llm import quality, toxicity
from quietframe.llm.labelled import held_out

DIR = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    scored = module.score(docs, module.train(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows[label]).mean() > least
    found, true = rows.predicted == 1, rows[label] == 1
    assert (found & true).sum() >= 0.94 * true.sum() and (found & true).sum() >= 0.95 * found.sum()
    assert rows.score.between(0, 1).all()
    assert ((rows.score >= module.CUT) == (rows.predicted == 1)).all()


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_defined_cases(spark, module, label):
    rows = [(i, ("good words here and there " if i % 2 else "||| %%% $$$ idiot ") * (i % 7 + 1), 1.0) for i in range(40)] + [(100, None, 0.0), (101, "", 0.0), (101, "", 0.0), (None, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.train(docs, labels)).toPandas()
    assert len(out) == 44 and np.isfinite(out.score).all()
    empty = out[out.doc_id.isin([100, 101])].score
    assert len(empty) == 3 and empty.nunique() == 1
    one_class = module.score(docs, module.train(docs, labels.where(f"{label} = 1")))
    assert one_class.count() == 44
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).collect() == []


def test_keep_returns_the_rows(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet").limit(3000), spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.train(docs, labels)
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_a_toxic_sentence_in_very_long_texts(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train(docs, labels)
    held = docs.join(labels.where("toxic = 0"), "doc_id").where("lang = 'en'").select("doc_id", "text").orderBy(F.length("text").desc()).limit(40)
    rows = [(r.doc_id, r.text) for r in held.collect()]
    assert max(len(t) for _, t in rows) > 10_000
    planted = [(i + 10**6, t + " you pathetic idiot, worthless scum, a stupid moron and a disgusting loser, you are trash, clown") for i, t in rows]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows + planted, "doc_id long, text string"), model).collect()}
    assert sum(got[i] for i, _ in rows) <= 1
    assert sum(got[i] for i, _ in planted) >= 39


def test_grams_against_counting():
    texts = ["abcabc xab", "", "aaaaaa", "zabcab ÀB", "ab", "x" * 50 + "y\n" * 9]
    own = [t.encode() for t in texts]
    doc, key = toxicity.grams(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
    for i, t in enumerate(texts):
        count = Counter(t[j : j + k] for k in toxicity.SIZES for j in range(len(t) - k + 1))
        mine = key[doc == i]
        assert len(mine) == len(set(mine.tolist())) == len(count) + sum(c > 1 for c in count.values())
        assert (mine & 1).sum() == sum(c > 1 for c in count.values())


def test_frequencies_against_counting(spark):
    rows = [(f"abc{i % 3} xyz", i % 2) for i in range(20)] + [("", 0), (None, 1)]
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    keys = np.unique(toxicity.grams(np.frombuffer(b"abc1", np.uint8), np.array([0, 4]))[1])
    got = {(r.df1, r.df0) for r in toxicity.frequencies(df, keys).collect()}
    has = lambda s, v: sum(1 for t, y in rows if t and s in t and y == v)
    assert got == {(has(s, 1), has(s, 0)) for s in ("abc", "bc1", "abc1")}


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.93, 1.0])
def test_threshold_is_the_quantile_of_all(spark, share):
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([rng.normal(size=300), np.full(40, 0.25)]))
    got = quality.threshold(spark.createDataFrame([(float(v),) for v in values], "strength double"), share, bins=7)
    k = max(1, min(len(values) - 1, round(share * len(values))))
    assert got == (values[k - 1] + values[k]) / 2
    assert quality.threshold(spark.createDataFrame([], "strength double"), share) == 0.0


def test_very_long_text_has_features():
    text = "word and | more ||| " * 200_000
    assert np.isfinite(quality.features(pa.array([text, "", None]))).all()


def plain_features(text):
    """The features of one text, word by word and character by character."""
    data = (text or "").encode()
    own = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n, some = max(len(data), 1), max(len(own), 1)
    symbol = lambda c: 32 < c < 127 and not chr(c).isalnum() and chr(c) not in ",."
    many = Counter(own)
    return [
        sum(map(symbol, data)) / n, sum(65 <= c <= 90 for c in data) / n, sum(48 <= c <= 57 for c in data) / n, data.count(b"|") / some,
        len(many) / some, max(many.values(), default=0) / some, sum(a == b for a, b in zip(own, own[1:])) / some, sum(len(w) <= 4 for w in own) / some,
        sum(sum(map(symbol, w)) >= 2 for w in own) / some, sum(map(len, own)) / some / 10, math.log1p(len(own)) / 10, float(not own),
    ]


TEXTS = ["", None, "one", "|| two | two | TWO 22 ||x", "a " * 50, "Ünï cödé, wörds. And-more; of (them) twice twice", " \n\t ", "x" * 300, "$$$ %%% 1 2 3"]


def test_features_against_plain_ones():
    got = quality.features(pa.array([*TEXTS, *TEXTS[::-1]]))
    want = [plain_features(t) for t in [*TEXTS, *TEXTS[::-1]]]
    # a mark that stands between two words belongs to the stretch from the first one on; here none does
    assert np.allclose(got, want)


def test_the_fit_is_the_optimum_of_its_loss():
    """Bradley-Terry by its definition: logistic loss of strength differences of drawn pairs, and a penalty."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    y = (x @ np.arange(12) / 20 + rng.normal(size=300) > 0).astype(int)
    model = quality.fit(x, y, pairs=4000)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    draw = np.random.default_rng(7)
    good, bad = (np.flatnonzero(y == v) for v in (1, 0))
    first, second = draw.choice(good, 4000), draw.choice(bad, 4000)

    def loss(beta):
        strength = z @ beta
        return np.mean(np.log1p(np.exp(-(strength[first] - strength[second])))) + 0.0015 * (beta**2).sum()

    best = loss(model["beta"])
    for i in range(12):
        for step in (-1e-3, 1e-3):
            assert loss(model["beta"] + step * np.eye(12)[i]) > best
    assert quality.fit(x, np.ones(300, int)) is None


def test_quality_of_a_table_against_a_plain_version(spark):
    """Every row of the smallest table, and ties: equal texts have equal scores."""
    where = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = quality.train(docs, labels)
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(twice, model).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        z = np.clip((np.array(plain_features(text)) - model["mean"]) / model["spread"], -6, 6)
        want = 1 / (1 + math.exp(-(float(z @ model["beta"]) - model["cut"] + math.log(0.7 / 0.3))))
        assert got[doc_id][0] == pytest.approx(want, abs=1e-6) and got[doc_id] == got[doc_id + 10**6]
        assert got[doc_id][1] == int(got[doc_id][0] >= 0.7)


def plain_hash(gram):
    """The 40-bit hash of an n-gram, digit by digit."""
    mask, rolled = (1 << 64) - 1, 0
    for i, c in enumerate(gram):
        value = (ord(c) * toxicity.BASE_A + 1) & mask
        rolled = value if i == 0 else (rolled * 0xD6E8FEB86659FD93 + value) & mask
    return ((((rolled ^ (rolled >> 29)) * 0x94D049BB133111EB) & mask) >> (65 - toxicity.KEY_BITS)) << 1


def folded(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")


def plain_margin(model, text):
    count = Counter(folded(text)[i : i + k] for k in toxicity.SIZES for i in range(len(text or "") - k + 1))
    weight = dict(zip(model["keys"].tolist(), model["weight"].tolist()))
    return model["bias"] + sum(weight.get(plain_hash(g), 0.0) + (weight.get(plain_hash(g) | 1, 0.0) if n > 1 else 0.0) for g, n in count.items())


def test_toxicity_of_a_table_against_a_plain_version(spark):
    where = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.train(docs, labels)
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(twice, model).collect()}
    for doc_id, text in docs.where("length(text) < 500").select("doc_id", "text").collect():
        want = 1 / (1 + math.exp(-max(-30, min(30, plain_margin(model, text)))))
        assert got[doc_id][0] == pytest.approx(want, abs=1e-6) and got[doc_id] == got[doc_id + 10**6]
        assert got[doc_id][1] == int(got[doc_id][0] >= 0.3)


def test_the_toxicity_fit_is_near_the_optimum_of_its_loss():
    """Logistic loss and penalty by their definitions: plain descent from there gains little more."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(30, rng.integers(2, 12), replace=False)) for _ in range(400)]
    truth, scale = rng.normal(size=30), rng.normal(size=30)
    y = np.array([float(truth[r].sum() + rng.normal() > 0) for r in rows])
    weight, bias = toxicity.fit(rows, y, scale, {0: int((y == 0).sum()), 1: int(y.sum())})
    own = weight / scale
    x = np.zeros((400, 30))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]

    def loss(w, b):
        margin = x @ w + b
        return np.mean(np.log1p(np.exp(margin)) - y * margin) + 1e-4 * (w**2).sum()

    best = loss(own, bias)
    start = loss(np.zeros(30), math.log(y.mean() / (1 - y.mean())))
    for _ in range(3000):  # plain gradient descent from there
        error = 1 / (1 + np.exp(-(x @ own + bias))) - y
        own, bias = own - 0.3 * (x.T @ error / len(y) + 2e-4 * own), bias - 0.3 * error.mean()
    assert best - loss(own, bias) < 0.15 * (start - best)  # its 120 steps end before the optimum
