"""Suffix-array dedup of bytes by prefix-free parsing.

Rolling-hash triggers cut the corpus into phrases (``repeats``).  Equal windows
of ``n`` bytes have equal anchors at equal distances, so a partition of anchors
decides about its windows alone, in this way:

* the dictionary: the distinct phrases before the anchors, with a suffix array
  (``orders.suffix_ranks``), and the distinct phrases after them in order, each
  up to the end of its next trigger, so that none is the beginning of another;
* the parse: what follows each anchor, as the ranks of its phrases.  Its suffix
  array is the order of these sequences of ranks, with common prefixes in bytes
  that come from the lengths of equal phrases and the dictionary's own;
* both combined are the corpus order of all suffixes that begin in a phrase
  before an anchor: by the rank of the rest of their phrase, then by the parse.
  A suffix that shares ``n`` bytes with a neighbour in that order starts a
  window that starts elsewhere too.

Bytes are compared here, no hash decides.  Anchors of more than ``HOT``
occurrences never meet in one task: their windows are counted by two 64-bit
hashes each (``repeats``).

Defined cases: null text is empty; a text of fewer than ``n`` bytes is kept; a
whole copy is removed on both sides, since windows are judged on the input;
repeated rows count as places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .frames import KEY, keyed, row_key, small_batches
from .orders import distinct_strings, longest_right, positions, range_min, sorted_rows, suffix_ranks
from .repeats import Kind
from .textcore import BYTE_VALUES, U64, Rolling, runs, text_buffers

N = 200
BYTES = Kind("byte", N, 160, 16, 128)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kind(n: int) -> Kind:
    """Lengths for windows of ``n`` bytes."""
    return BYTES if n == N else Kind("byte", n, max(1, n * 4 // 5), max(1, min(16, n // 8)), 128)


def phrases(kind: Kind, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the phrases of the stretches begin:end: cut at triggers, each with the next trigger at its end."""
    found = [np.zeros(0, np.int64)]
    for first, last in runs(np.append(begin, end[-1])):  # a slice at a time: what is per byte stays small
        own = data[begin[first] : end[last - 1]]
        if len(own) >= kind.gram:
            found.append(np.flatnonzero(Rolling(BYTE_VALUES[own]).all(kind.gram) % U64(kind.every) == 0) + begin[first])
    at = np.concatenate(found)
    # stretches do not overlap and are in order: the stretch of a trigger is the last that begins before it
    row = np.searchsorted(begin, at, "left") - 1
    inside = (row >= 0) & (at + kind.gram <= end[row])
    starts, rows = np.concatenate([begin, at[inside]]), np.concatenate([np.arange(len(begin)), row[inside]])
    order = np.argsort(starts, kind="stable")
    starts, rows = starts[order], rows[order]
    last = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last, end[rows], np.append(starts[1:], 0) + kind.gram)
    return rows, starts, np.minimum(ends, end[rows])


def parse_order(kind: Kind, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the stretches begin:end by the ranks of their phrases, and each one's common bytes with the one before it."""
    rows, start, stop = phrases(kind, data, begin, end)
    first, rank = distinct_strings(data, start, stop - start)
    step = np.arange(len(rows)) - np.searchsorted(rows, rows)
    most = int(step.max(initial=0)) + 1
    ranks = np.zeros((len(begin), most), np.int64)
    ranks[rows, step] = rank + 1
    offset = np.repeat((end - begin)[:, None], most + 1, axis=1)
    offset[rows, step] = start - begin[rows]
    order, equal = sorted_rows(ranks)
    common = np.zeros(len(begin), np.int64)
    if len(begin) > 1:
        a, b, m = order[:-1], order[1:], equal[1:]
        common[1:] = np.minimum(offset[a, m], offset[b, m])
        some = np.flatnonzero(m < most)
        x, y = ranks[a[some], m[some]] - 1, ranks[b[some], m[some]] - 1
        both = (x >= 0) & (x < y)
        length, lead = (stop - start)[first], start[first]
        shared = np.zeros(len(first), np.int64)
        alive = np.arange(1, len(first))
        for i in range(int(length.max(initial=0))):  # common bytes of neighbours in the dictionary
            alive = alive[(length[alive] > i) & (length[alive - 1] > i)]
            alive = alive[data[lead[alive] + i] == data[lead[alive - 1] + i]]
            shared[alive] += 1
        if both.any():
            common[1:][some[both]] += range_min(shared)(x[both] + 1, y[both] + 1)
    return order, common


def resolve(kind: Kind, data: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """hit[row, a]: whether the window that starts ``a`` bytes before the row's anchor starts elsewhere too."""
    anchor = offsets[:-1] + hi
    order, common = parse_order(kind, data, anchor, offsets[1:])
    first, phrase = distinct_strings(data, offsets[:-1], hi)
    bounds = np.append(0, np.cumsum(hi[first]))
    dictionary = data[np.repeat(offsets[:-1][first] - bounds[:-1], hi[first]) + np.arange(bounds[-1])]
    suffixes = np.append(suffix_ranks(dictionary, bounds) + 1, 0)
    many = hi - lo + 1
    row = np.repeat(np.arange(len(hi)), many)
    back = np.repeat(hi, many) - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    head = np.where(back > 0, suffixes[bounds[phrase[row] + 1] - back], 0)
    hit = np.zeros((len(hi), int(hi.max()) + 1), bool)
    hit[row, back] = back + longest_right(head, positions(order)[row], common) >= kind.n
    return hit


def removed(df: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """doc_id, text and the spans (arrays ``first`` and ``last``) of the bytes to remove."""
    docs = keyed(df, id_col, text_col)
    return repeats.with_spans(docs, repeats.covered(docs, kind(n), resolve, hot))


def dedup(df: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """Digest of what is left of each document."""

    def apply(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                gone = repeats.cover(len(own), first, last)
                out[0].append(len(own))
                out[1].append(int(gone.sum()))
                out[2].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out[3].append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(df, n, id_col, text_col, hot).mapInArrow(apply, SCHEMA)


def rewrite(df: DataFrame, n: int = N, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with repeated stretches cut out of their text; other columns as they are.

    A span is narrowed to whole characters, so that the text stays valid; a
    column ``n_chars``, if there is one, follows the text.
    """
    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            texts = []
            for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                gone = repeats.cover(len(own), first, last)
                lead = np.flatnonzero((own & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(gone, lead) if len(lead) else gone
                keep = np.repeat(~whole, np.diff(np.append(lead, len(own)))) if len(lead) else ~gone
                texts.append(own[keep].tobytes().decode("utf-8", "replace"))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    named = list(df.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in named if c not in (text_col, "n_chars")])
    docs = small_batches(df).select(rest.alias("row"), *row_key(id_col, text_col), text.alias("text"))
    joined = docs.join(repeats.covered(docs, kind(n), resolve), KEY, "left").select("row", "text", F.transform("spans", lambda s: s["first"]).alias("first"), F.transform("spans", lambda s: s["last"]).alias("last"))
    out = joined.mapInArrow(cut, joined.schema)
    fresh = {text_col: F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in named])
