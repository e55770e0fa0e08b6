"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 6 characters of the whole text (A-Z
and Latin-1 capitals in lower case, white space as a space), and once more those
that occur twice or more, told apart by 40-bit hashes.  Each is scaled by the logarithm of the ratio of its smoothed document
frequencies among toxic and other texts, and a logistic regression is fitted on
the scaled features.

What training takes is bounded by parameters:

* ``per_class`` labelled rows of each class at most (3,000), none of them held
  out, with texts of at most ``longest`` bytes (2**16);
* n-grams seen in ``LEAST`` texts of a pilot of ``pilot`` texts of each class
  (500) are candidates; their document frequencies are counted by Spark over the
  whole sample, and the ``features`` (8,000) with the largest chi-square are
  fitted.  The driver holds the pilot's texts and the fitted n-grams' numbers for
  each row of the sample, no other text.

The intercept is moved back to the classes' frequencies in all labelled rows
that are not held out.  An n-gram that is not fitted scores nothing, so that a
long text is judged by the same n-grams as a short one.

Defined cases: null and empty text have no features and get the score of the
intercept; a label table without both classes scores every document by the
share of the class it has (0 without labels); repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, documents
from .labelled import held_out, sampled
from .textcore import BASE_A, U64, runs, text_buffers

PER_CLASS = 3000
PILOT = 500
FEATURES = 8000
LONGEST = 1 << 16
LEAST = 3
SIZES = (3, 4, 5, 6)
KEY_BITS = 40
CUT = 0.3
SCHEMA = "doc_id long, score double"


#: Bits of a hash by which most n-grams that nobody asks for are passed over.
TABLE_BITS = 20


def table_of(keys: np.ndarray) -> np.ndarray:
    """Which leading bits any of the hashes has."""
    out = np.zeros(1 << TABLE_BITS, bool)
    out[keys >> (KEY_BITS - TABLE_BITS)] = True
    return out


def grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram, each once a document, by document; the last bit marks those that occur twice or more.

    With a ``table``, n-grams whose leading bits are not in it are left out.
    """
    lead = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.append(0, np.cumsum(lead))
    bounds = at[offsets] if len(chars) == at[-1] else None
    if bounds is None:  # not valid UTF-8: bytes stand for characters
        chars, bounds = data.astype(np.uint32), offsets
    upper = (chars >= 65) & (chars <= 90) | (chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7)
    chars = np.where(upper, chars + 32, np.where((chars >= 9) & (chars <= 13), 32, chars)).astype(U64)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=U64), np.diff(bounds))
    value = chars * U64(BASE_A) + U64(1)
    rolled, found = value, []
    for size in range(2, SIZES[-1] + 1):
        if len(chars) < size:
            break
        rolled = rolled[:-1] * U64(0xD6E8FEB86659FD93) + value[size - 1 :]
        if size in SIZES:
            inside = doc[: len(rolled)] == doc[size - 1 :]
            key = ((rolled ^ (rolled >> U64(29))) * U64(0x94D049BB133111EB) >> U64(65 - KEY_BITS)) << U64(1)
            if table is not None:
                inside &= table[key >> U64(KEY_BITS - TABLE_BITS)]
            at = np.flatnonzero(inside)
            found.append(doc[at] << U64(KEY_BITS) | key[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.sort(np.concatenate(found))
    new = np.append(True, every[1:] != every[:-1])[: len(every)]
    again = every[1:][~new[1:] & np.append(True, new[1:-1])[: len(every) - 1]] if len(every) > 1 else every[:0]
    both = np.sort(np.concatenate([every[new], again | U64(1)])).view(np.int64)
    return both >> KEY_BITS, both & ((1 << KEY_BITS) - 1)


def slots(column: pa.Array, keys: np.ndarray):
    """For each run of texts: its first and end text, and (text, place in ``keys``) of the n-grams that are among ``keys``."""
    data, offsets = text_buffers(column)
    table = table_of(keys)
    for a, b in runs(offsets):
        doc, key = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        place = np.searchsorted(keys, key).clip(max=max(0, len(keys) - 1))
        known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
        yield a, b, doc[known], place[known]


def candidates(column: pa.Array) -> np.ndarray:
    """The hashes of n-grams that ``LEAST`` texts of the pilot have, ascending."""
    data, offsets = text_buffers(column)
    found = [grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1] for a, b in runs(offsets)]
    keys, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
    return keys[count >= LEAST]


def frequencies(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """at, df1 and df0: how many toxic and other texts of the sample have the n-gram at that place of ``keys``."""
    known = rows.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        for batch in batches:
            y, all_keys = batch.column("label").to_numpy(), known.value
            df = np.zeros((2, len(all_keys)), np.int64)
            for a, b, doc, place in slots(batch.column("text"), all_keys):
                for label in (0, 1):
                    df[label] += np.bincount(place[y[a:b][doc] == label], minlength=len(all_keys))
            at = np.flatnonzero(df.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[1][at]), pa.array(df[0][at])], ["at", "df1", "df0"])

    return rows.mapInArrow(count, "at int, df1 long, df0 long").groupBy("at").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0"))


def fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on the scaled features (Adam over the whole sample)."""
    n, many = len(y), np.array([len(r) for r in rows])
    cols = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    row = np.repeat(np.arange(n), many)
    by_col = np.argsort(cols, kind="stable")
    row_of_col, edges = row[by_col], np.searchsorted(cols[by_col], np.arange(len(scale) + 1))
    totals = lambda v, at: np.diff(np.append(0, np.cumsum(v))[at])
    row_edges = np.append(0, np.cumsum(many))
    pos = y.sum()
    weight, bias = np.zeros(len(scale)), np.log(pos / (n - pos))
    m = [np.zeros(len(scale)), np.zeros(len(scale))]
    rate, penalty = 0.05, 2e-4
    for step in range(1, 121):
        margin = totals((scale * weight)[cols], row_edges) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        gradient = totals(error[row_of_col], edges) * scale / n + penalty * weight
        m[0] = 0.9 * m[0] + 0.1 * gradient
        m[1] = 0.99 * m[1] + 0.01 * gradient**2
        weight -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        bias -= 0.5 * error.mean()
    return weight * scale, float(bias + np.log(counts[1] / counts[0]) - np.log(pos / (n - pos)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, pilot: int = PILOT, longest: int = LONGEST):
    """The model, or the share of label 1 where there is nothing to tell apart."""
    rows, counts = sampled(docs, labels, label, per_class, longest)
    rows = checkpoint(rows)
    size = {int(r["label"]): int(r["count"]) for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    first = [rows.where(F.col("label") == v).orderBy("order", "doc_id", "text").limit(pilot) for v in (0, 1)]
    keys = candidates(first[0].unionByName(first[1]).select("text").toArrow().column("text"))
    both, n, pos = F.col("df1") + F.col("df0"), sum(size.values()), size[1]
    expected = both * pos / n
    chi = F.pow(F.col("df1") - expected, 2) / (expected * (1 - both / n) * (1 - pos / n) + 1e-9)
    chosen = frequencies(rows, keys).where(chi > 0).orderBy(chi.desc(), "at").limit(features).toArrow().sort_by("at")
    at, df1, df0 = (chosen.column(c).to_numpy() for c in ("at", "df1", "df0"))
    keys = keys[at]
    scale = np.log((df1 + 1) / (pos + 2)) - np.log((df0 + 1) / (n - pos + 2))
    known = docs.sparkSession.sparkContext.broadcast(keys)

    def hits(batches):
        for batch in batches:
            y = batch.column("label").to_numpy()
            for a, b, doc, place in slots(batch.column("text"), known.value):
                edges = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b]), pa.ListArray.from_arrays(pa.array(edges), pa.array(place.astype(np.int32)))], ["label", "hits"])

    found = rows.orderBy("order", "doc_id", "text").select("label", "text").mapInArrow(hits, "label int, hits array<int>").toArrow()
    weight, bias = fit([r.values.to_numpy() if r.is_valid else np.zeros(0, np.int32) for r in found.column("hits")], found.column("label").to_numpy(), scale, counts)
    return {"keys": keys, "weight": weight, "bias": bias}


def margins(model: dict, column: pa.Array) -> np.ndarray:
    out = np.full(len(column), model["bias"])
    for a, b, doc, place in slots(column, model["keys"]):
        out[a:b] += np.bincount(doc, model["weight"][place], b - a)
    return out


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            if isinstance(shared.value, float):
                value = np.full(batch.num_rows, shared.value)
            else:
                value = 1 / (1 + np.exp(-np.clip(margins(shared.value, batch.column("text")), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", "score"])

    out = documents(docs, id_col, text_col).mapInArrow(scored, SCHEMA)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
