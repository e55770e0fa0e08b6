"""Substring dedup of words by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks (``repeats``: the stretches around equal
anchors; every window lies in one of them and every block is indexed).  The
index of a task's blocks is their order of suffixes: by the words before the
anchor, read backwards, and by those from it on.  Each block is factored
greedily against all others.  A factor begins where the parse stands; the index
is asked for the longest match of the block's suffix from there with another
block, and the factor is that match.  If it has ``n`` words or more it is a
duplicate span, and the parse goes on at its boundary: at the first window that
straddles the factor's end, which another block may hold.  Else it goes on one
word further.  Starts inside a factor are never looked up: what a factor holds is
decided by the factor.

Words are compared by their bytes.  Blocks of anchors of more than ``HOT``
occurrences never meet in one task: their windows are counted by two 64-bit
hashes, made of different hashes of the words (``repeats``).

Defined cases: null text has no words; a text of fewer than ``n`` words is kept;
copies are removed on both sides; repeated rows count as places of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .frames import keyed
from .orders import positions, range_min, sorted_rows
from .repeats import Kind
from .textcore import text_buffers, word_hashes, words

N = 35
WORDS = Kind("word", N, 24, 2, 16)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kind(n: int) -> Kind:
    """Lengths for windows of ``n`` words."""
    return WORDS if n == N else Kind("word", n, max(1, n * 2 // 3), 1, 16)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from 1 on for each word; words have the same number if their bytes are the same."""
    h = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(data[a:b], start[i:j] - a, end[i:j] - a) for a, b, i, j in _slices(start, end))])
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    length, like = end - start, first[ids]
    same = length == length[like]
    rows = np.flatnonzero(same & (like != np.arange(len(like))))
    for part in np.array_split(rows, 1 + len(rows) // 100_000):
        size = length[part]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = data[np.repeat(start[part], size) + step] != data[np.repeat(start[like[part]], size) + step]
        same[np.repeat(part, size)[differ]] = False
    if not same.all():  # two words of one hash: number them by their bytes
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start, end)])
    return ids + 1


def _slices(start: np.ndarray, end: np.ndarray, limit: int = 1 << 19):
    """(first byte, end byte, first word, end word) of stretches of whole words of about ``limit`` bytes."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + limit, "right")))
        yield int(start[i]), int(end[j - 1]), i, j
        i = j


class Index:
    """The suffixes of all blocks: each has ``hi`` words before its anchor and goes on from there."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        self.hi, self.size = hi, np.diff(bounds)
        anchor = bounds[:-1] + hi

        def reach(length: np.ndarray, step: int) -> np.ndarray:
            k = np.arange(int(length.max(initial=0)))
            inside = k < length[:, None]
            at = anchor[:, None] + (k if step > 0 else -1 - k)
            return np.where(inside, ids[np.where(inside, at, 0)], 0)

        self.left, self.left_common = sorted_rows(reach(hi, -1))
        right, self.common = sorted_rows(reach(self.size - hi, 1))
        self.rank = positions(right)
        self.lo = lo

        self.least = range_min(self.common)
        self.head = np.empty(len(hi), np.int64)

    def match(self, rows: np.ndarray, a: int) -> np.ndarray:
        """Words of the longest match, with another block, of the suffixes that begin ``a`` words before the anchors of ``rows``."""
        self.head[self.left] = np.cumsum(self.left_common < a)
        asked = np.zeros(int(self.head.max()) + 1, bool)
        asked[self.head[rows]] = True
        others = np.flatnonzero((self.lo <= a) & (a <= self.hi) & asked[self.head])  # the suffixes of the same head words
        order = others[np.argsort(self.head[others] * (len(self.common) + 1) + self.rank[others], kind="stable")]
        place = np.empty(len(self.hi), np.int64)
        place[order] = np.arange(len(order))
        found = np.full(len(rows), -1, np.int64)
        for step in (-1, 1):  # in corpus order the longest match is one of the two neighbours
            near = place[rows] + step
            some = np.flatnonzero((near >= 0) & (near < len(order)))
            other = order[near[some]]
            alike = self.head[other] == self.head[rows[some]]
            some, other = some[alike], other[alike]
            one, two = self.rank[rows[some]], self.rank[other]
            found[some] = np.maximum(found[some], self.least(np.minimum(one, two) + 1, np.maximum(one, two) + 1))
        return np.where(found < 0, 0, np.minimum(a + found, self.size[rows] - self.hi[rows] + a))


def factors(index: Index, n: int) -> np.ndarray:
    """Greedy factors of every block, as hit[row, a]: the window that starts ``a`` words before the anchor lies in a factor of ``n`` words or more.

    All blocks go on together, each from its first window to its last one;
    ``at[row]`` is where its parse stands.
    """
    lo, hi = index.lo, index.hi
    hit = np.zeros((len(hi), int(hi.max(initial=0)) + 1), bool)
    at = hi.copy()
    for a in range(hit.shape[1] - 1, -1, -1):
        rows = np.flatnonzero((at == a) & (lo <= a))
        if not len(rows):
            continue
        held = np.maximum(index.match(rows, a) - n + 1, 0)  # windows that the factor holds
        for k in range(int(held.max(initial=0))):
            some = rows[(held > k) & (a - k >= lo[rows])]
            hit[some, a - k] = True
        at[rows] = a - np.maximum(held, 1)
    return hit


def resolve(kind: Kind, data: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """hit[row, a]: whether a factor holds the window that starts ``a`` words before the row's anchor."""
    start, end, bounds = words(data, offsets)
    return factors(Index(word_ids(data, start, end), bounds, hi, lo), kind.n)


def removed(df: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """doc_id, text and the spans (arrays ``first`` and ``last``) of the words to remove."""
    docs = keyed(df, id_col, text_col)
    return repeats.with_spans(docs, repeats.covered(docs, kind(n), resolve, hot))


def dedup(df: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT, with_text: bool = False) -> DataFrame:
    """Digest of the kept words of each document; ``with_text`` adds the kept words themselves."""

    def apply(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                start, end, _ = words(own, np.array([0, len(own)]))
                gone = repeats.cover(len(start), first, last)
                keep = np.flatnonzero(~gone)
                kept = b""
                if len(keep):  # kept words and one space after each, as one gather
                    length = end[keep] - start[keep] + 1
                    at = np.cumsum(length)
                    source = np.repeat(start[keep] - (at - length), length) + np.arange(at[-1])
                    joined = np.append(own, np.uint8(32))[source]
                    joined[at - 1] = 32
                    kept = joined[:-1].tobytes()
                out[0].append(len(start))
                out[1].append(int(gone.sum()))
                out[2].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out[3].append(kept.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:2]), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(out[3], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return removed(df, n, id_col, text_col, hot).mapInArrow(apply, SCHEMA + (", kept string" if with_text else ""))
