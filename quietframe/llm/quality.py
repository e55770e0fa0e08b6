"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text.
Pairs of a document labelled good and one labelled bad are preferences; the
weights minimise the logistic loss on the feature differences (Newton steps
with an L2 penalty).  The threshold is a quantile of the strengths of all
labelled documents that are not held out: the share of bad labels falls below
it.  The score maps the threshold to 0.7.

The weights are fitted on a bounded sample: ``per_class`` rows of each label at
most (2,000), none of them held out, with texts of at most ``longest`` bytes
(2**20), and ``pairs`` random pairs of them (20,000).  Only their features come
to the driver, no text.

Defined cases: null and empty text get the score of a text without words; a
label table without both classes gives every document the score 0.5 and so
rejects it; repeated rows are scored each; ties are equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, documents, small_batches
from .labelled import held_out, learnable, sampled
from .textcore import runs, text_buffers, word_hashes, words

PER_CLASS = 2000
PAIRS = 20000
LONGEST = 1 << 20
CUT = 0.7
SCHEMA = "doc_id long, score double"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text: shares of kinds of characters and words, variety, repetition and length."""
    data, offsets = text_buffers(column)
    return np.concatenate([_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in runs(offsets)] or [np.zeros((0, 12))])


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(offsets), 1)
    start, end, w = words(data, offsets)
    nw = np.diff(w)
    some = np.maximum(nw, 1)
    symbol = (data > 32) & (data < 127) & ~((data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | (data == 44) | (data == 46))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    h = word_hashes(data, start, end)
    doc = np.repeat(np.arange(len(nw)), nw)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=len(nw))
    first = np.flatnonzero(new)
    top = np.zeros(len(nw), np.int64)
    np.maximum.at(top, ds[first], np.diff(np.append(first, len(hs))))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = end - start
    per_word = lambda mask: _sums(mask, w) / some
    bare = np.zeros(len(start), bool)
    if len(start):
        bare = np.add.reduceat(symbol.astype(np.int64), start) >= 2
    return np.column_stack([
        _sums(symbol, offsets) / n, _sums(upper, offsets) / n, _sums(digit, offsets) / n, _sums(data == 124, offsets) / some.clip(1),
        distinct / some, top / some, per_word(same), per_word(length <= 4), per_word(bare),
        _sums(length, w) / some / 10, np.log1p(nw) / 10, nw == 0,
    ]).astype(float)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict[str, np.ndarray | float] | None:
    """Weights and scale, with a threshold of 0; None if a class is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    beta, penalty = np.zeros(x.shape[1]), 0.003
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - penalty * beta
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    return {"mean": mean, "spread": spread, "beta": beta, "cut": 0.0}


def strengths(model, x: np.ndarray) -> np.ndarray:
    """Strengths above the threshold."""
    z = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    return z @ model["beta"] - model["cut"]


def _strength_column(docs: DataFrame, model) -> DataFrame:
    def emit(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(strengths(model, features(batch.column("text"))))], ["doc_id", "strength"])

    return docs.mapInArrow(emit, "doc_id long, strength double")


def threshold(values: DataFrame, share: float, bins: int = 4096) -> float:
    """The ``share`` quantile of a column ``strength``, exactly: the middle of the two values around it.

    Two counts by bins find the bin of the quantile; its values alone are
    sorted, with their repetitions counted.
    """
    low, high, total = values.agg(F.min("strength"), F.max("strength"), F.count("strength")).first()
    if not total:
        return 0.0
    want, before = max(1, min(total - 1, round(share * total))), 0
    for _ in range(2):
        if low == high:
            break
        width = (high - low) / bins
        bin_of = F.least(F.floor((F.col("strength") - low) / width), F.lit(bins - 1))
        inside = values.where(F.col("strength").between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("strength").alias("low"), F.max("strength").alias("high")).orderBy("bin").collect()
        for r in inside:
            if before + r["n"] >= want:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    for r in values.where(F.col("strength").between(low, high)).groupBy("strength").count().orderBy("strength").toLocalIterator():
        before += r["count"]
        if before >= want:
            at = r["strength"]
            break
    after = values.where(F.col("strength") > at).agg(F.min("strength")).first()[0] if before == want else at
    return (at + (at if after is None else after)) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, pairs: int = PAIRS, longest: int = LONGEST):
    """The model; None if a class is missing.  All learnable documents are scored once for the threshold."""
    rows, counts = sampled(docs, labels, label, per_class, longest)

    def measured(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["order", "label", "x"])

    sample = rows.mapInArrow(measured, "order long, label int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), float)
    y = sample.column("label").to_numpy()
    order = np.lexsort((*x.T, sample.column("order").to_numpy())) if len(y) else np.zeros(0, np.int64)
    model = fit(x[order], y[order], pairs)
    if model is None:
        return None
    # strengths first: what is joined are numbers, not texts
    known = _strength_column(documents(docs), model).join(learnable(labels, label).select("doc_id"), "doc_id", "left_semi")
    return model | {"cut": threshold(checkpoint(known), counts[0] / (counts[0] + counts[1]))}


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document; no shuffle."""

    def scored(batches):
        for batch in batches:
            n = batch.num_rows
            if model is None:
                value = np.full(n, 0.5)
            else:
                margin = strengths(model, features(batch.column("text")))
                value = 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", "score"])

    out = documents(docs, id_col, text_col).mapInArrow(scored, SCHEMA)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, model) -> DataFrame:
    """The rows, with all their columns, whose text is predicted good; no shuffle and no join."""
    fields = docs.schema

    def kept(batches):
        for batch in batches:
            if model is None:
                continue
            margin = strengths(model, features(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(margin >= 0))

    return small_batches(docs).mapInArrow(kept, fields)
