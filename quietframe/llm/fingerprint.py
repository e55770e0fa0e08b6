"""Threshold-scaled sketches of documents.

The sketch of a text keeps every shingle hash below ``1/SCALE`` of the hash
range, so that its size follows the text's, sketches of parts merge by union,
and containment of a short text in a long one is estimated as well as likeness
of equals.  Shingles are five words (as they stand, without change of case); a
text of fewer words is one shingle.

The fingerprint string is the base64 of the kept hashes, ascending, as 8 bytes
each.  A text whose shingles all lie above the threshold keeps its smallest one
instead, which its value tells (it is above the threshold), so that only texts
without words have the empty string.  ``merged`` knows this: it drops such a
value as soon as there is one below the threshold, so the merged sketch of parts
is the sketch of their shingles taken together.

The standard error of a likeness J is about ``sqrt(J (1 - J) SCALE / n)`` for
``n`` shingles in both texts together: 0.03 at 1,000, 0.14 at 50.  Containment in
a long text cannot be told for a text that keeps its smallest hash alone (most
often fewer than ``SCALE`` shingles): it is 1 if the other text keeps that hash
and 0 otherwise.

Defined cases: null text is empty; two empty sketches have likeness 1, one empty
sketch has likeness 0; the last document's next one is the first; a single
document is its own next; rows of one identifier are taken in the order of their
texts; a null identifier comes first; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents, partitions
from .textcore import U64, Rolling, mix, runs, text_buffers, word_hashes, words

SHINGLE = 5
SCALE = 4
#: Blocks of ascending identifiers at most; a block is sorted with spill and read as a stream.
MOST_BLOCKS = 20_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def sketches(column: pa.Array, scale: int = SCALE, size: int = SHINGLE) -> list[np.ndarray]:
    """The kept hashes of every text, ascending and distinct."""
    data, offsets = text_buffers(column)
    out: list[np.ndarray] = []
    limit = U64((1 << 64) // scale - 1)
    for a, b in runs(offsets):
        own = data[offsets[a] : offsets[b]]
        start, end, bounds = words(own, offsets[a : b + 1] - offsets[a])
        count = np.diff(bounds)
        roll = Rolling(word_hashes(own, start, end))
        whole = roll.all(size)
        doc = np.repeat(np.arange(b - a), count)
        inside = doc[: len(whole)] == doc[size - 1 :] if len(whole) else np.zeros(0, bool)
        short = np.flatnonzero((count > 0) & (count < size))
        h = mix(np.concatenate([whole[inside], roll.of(bounds[short], count[short])]))
        d = np.concatenate([doc[: len(whole)][inside], short])
        least = np.full(b - a, ~U64(0))
        np.minimum.at(least, d, h)
        keep = (h <= limit) | (h == least[d])
        h, d = h[keep], d[keep]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
        h, d = h[new], d[new]
        edges = np.searchsorted(d, np.arange(b - a + 1))
        out.extend(h[s:e] for s, e in zip(edges[:-1], edges[1:]))
    return out


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read_sketch(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merged(*parts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of texts taken together (without the shingles that span two of them)."""
    both = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)
    below = both[both <= U64((1 << 64) // scale - 1)]
    return below if len(below) else both[:1]


def likeness(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Estimated Jaccard similarity, and containment of the smaller sketch in the larger."""
    if not len(x) or not len(y):
        same = float(len(x) == len(y))
        return same, same
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(x) + len(y) - common), common / min(len(x), len(y))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def rank_among(value: Column, limits: list[int]) -> Column:
    """How many of the ascending limits are at most ``value``, looked up in two steps of about their square root."""
    if not limits:
        return F.lit(0)
    step = math.isqrt(len(limits)) + 1
    rows = [limits[i : i + step] for i in range(0, len(limits), step)]
    whole = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda x: x <= value))
    row = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), F.greatest(whole, F.lit(1)))
    return (F.greatest(whole - 1, F.lit(0)) * step + F.size(F.filter(row, lambda x: x <= value))).cast("int")


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """The documents in blocks of ascending identifiers; each block also holds the row after its last, marked ``border``.

    Block limits are quantiles of the identifiers.  What comes to the driver is
    one limit and one first identifier a block.
    """
    limits = [q for q in docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts))] if parts > 1 else []
    limits = sorted({int(q) for q in limits})
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    block = rank_among(order, limits)
    placed = docs.withColumn("block", block.cast("int"))
    key = F.struct(order.alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    firsts = [(r["block"], r["o"]) for r in placed.groupBy("block").agg(F.min(order).alias("o")).orderBy("block").collect()]
    own = placed.select("block", "doc_id", "text", F.lit(False).alias("border"))
    if not firsts:
        return own
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}
    ids = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    # all rows of a block's first identifier may be candidates for its first row: the smallest text is taken
    head = placed.where(order.isin(list(before))).groupBy("block").agg(F.min_by(F.struct("doc_id", "text", order.alias("o")), key).alias("h"))
    border = head.select(ids[F.col("h.o")].cast("int").alias("block"), "h.doc_id", "h.text", F.lit(True).alias("border"))
    return own.unionByName(border)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, with_text: bool = False) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; one shuffle of the texts."""
    p = partitions(df.sparkSession)
    docs = documents(df, id_col, text_col)
    placed = blocks(docs, min(MOST_BLOCKS, 4 * p)).repartition(p, "block").withColumn("rest", F.coalesce("text", F.lit("")))
    placed = placed.sortWithinPartitions("block", "border", F.col("doc_id").asc_nulls_first(), "rest").select("block", "border", "doc_id", F.col("rest").alias("text"))

    def digest(ids, texts, own, nexts, next_sketch):
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        other = sketches(pa.array(changed, pa.large_string()), scale)
        near = [likeness(a, b) for a, b in zip(own, other)]
        after = [likeness(a, b) for a, b in zip(own, next_sketch)]
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array([written(s) for s in own], pa.string()), pa.array([written(s) for s in other], pa.string()),
            *(pa.array([v[i] for v in rows], pa.float64()) for i in (0, 1) for rows in (near, after)),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
        if with_text:
            columns.append(pa.array(changed, pa.string()))
            names.append("edited")
        return pa.RecordBatch.from_arrays(columns, names)

    def emit(batches):
        last = None  # block, doc_id, text and sketch of the row that waits for its next one
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                block, border = batch.column("block").to_pylist(), batch.column("border").to_pylist()
                ids, texts, own = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), sketches(batch.column("text"), scale)
                rows = ([last] if last else []) + list(zip(block, border, ids, texts, own))
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:]) if a[0] == b[0] and not a[1]]
                last = rows[-1]
                if pairs:
                    yield digest([a[2] for a, _ in pairs], [a[3] for a, _ in pairs], [a[4] for a, _ in pairs], [b[3] for _, b in pairs], [b[4] for _, b in pairs])

    return placed.mapInArrow(emit, SCHEMA + (", edited string" if with_text else ""))
