"""Windows of ``n`` tokens that occur more than once in a corpus: the distributed frame.

Text is parsed at triggers.  A position is a trigger if the rolling hash of its
next ``gram`` tokens is 0 modulo ``every``; a window takes the first trigger in
its first ``reach`` positions, and where there is none the smallest rolling
hash of that stretch.  So every window of ``n`` tokens has one anchor, which
its content alone decides, and equal windows have equal anchors at equal
distances.  A phrase is what lies between anchors.

1. Every anchor gives the hash of the ``n - reach + 1`` tokens from it on, which
   all its windows share.  The hashes are counted (partial aggregation); only
   those that occur twice can hold a repeated window.
2. Anchors of such hashes send the text of their windows to the hash's
   partition, where a ``resolver`` decides which windows are equal.
3. Hashes of more than ``HOT`` occurrences never meet in one task: their windows
   are counted one by one, by two 64-bit hashes each.  A window that a task sees
   for the second time is decided there, as are all later ones; only the first
   one of each task goes on, with a second row that tells the count if there were
   more.  So a window has two rows a task at most where it is counted, however
   many places it has.  No case is dropped on either way.

The result holds the starts of all repeated windows as spans of covered tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import KEY, partitions
from .textcore import BASE_A, BASE_B, BYTE_VALUES, U64, Rolling, runs, text_buffers, word_hashes, words

#: Occurrences from which an anchor's windows are counted one by one.
HOT = 2000
#: Bytes of context that a resolver takes at once, cut at a change of the hash.
CHUNK = 2 << 20
ROWS_AT_ONCE = 2000
POSITION = U64((1 << 20) - 1)
CONTEXT, WINDOW, DECIDED, COUNTED = 0, 1, 2, 3


@dataclass(frozen=True)
class Kind:
    """What a token is, and the lengths of window, anchor stretch and trigger."""

    unit: str
    n: int
    reach: int
    gram: int
    every: int

    def __post_init__(self):
        if self.reach + self.gram > self.n:
            raise ValueError("a window has to hold its anchor's stretch and trigger")

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token values, first byte and end byte of each token, token offsets of the documents."""
        if self.unit == "byte":
            at = np.arange(len(data))
            return BYTE_VALUES[data], at, at + 1, offsets
        start, end, bounds = words(data, offsets)
        return word_hashes(data, start, end), start, end, bounds

    def proofs(self, data: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Other token values: what two tokens share in one of both they hardly share in the other."""
        return values if self.unit == "byte" else word_hashes(data, start, end, other=True)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if width < k else x


def anchors(kind: Kind, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that have windows, with the smallest and the largest distance of a window's start before them."""
    size = 1 << 20
    if len(values) > size:  # one long document: stretches of window starts, each with the text its windows need
        parts = []
        for s in range(0, len(values), size // 2):
            piece = values[s : s + size // 2 + kind.n - 1]
            t, lo, hi = anchors(kind, piece, np.array([0, len(piece)]))
            parts.append((t + s, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*parts))
    m = len(values) - kind.n + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none, none
    h = Rolling(values).all(kind.gram)
    rank = np.where(h % U64(kind.every) == 0, U64(0), h & ~POSITION) | np.arange(len(h), dtype=U64)
    best = sliding_min(rank, kind.reach)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    i = np.flatnonzero(np.arange(m) + kind.n <= ends[:m])
    if not len(i):
        return none, none, none
    t = (best[i] & POSITION).astype(np.int64)
    new = np.append(True, t[1:] != t[:-1])
    first, last = i[new], i[np.append(new[1:], True)]
    return t[new], t[new] - last, t[new] - first


def scan(kind: Kind, column: pa.Array):
    """For each run of documents: first document, bytes, byte offsets, tokens and anchors."""
    data, offsets = text_buffers(column)
    for a, b in runs(offsets):
        own = data[offsets[a] : offsets[b]]
        values, start, end, bounds = kind.tokens(own, offsets[a : b + 1] - offsets[a])
        t, lo, hi = anchors(kind, values, bounds)
        if len(t):
            roll = Rolling(values)
            key = roll.of(t, kind.n - kind.reach + 1).view(np.int64)
            yield a, own, values, start, end, bounds, t, lo, hi, key, np.searchsorted(bounds, t, "right") - 1


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches data[start:end] as a binary column."""
    length = end - start
    offsets = np.append(0, np.cumsum(length))
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())


def _keys(kind: Kind):
    def emit(batches):
        for batch in batches:
            found = [x[9] for x in scan(kind, batch.column("text"))]
            if found:
                key, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count.astype(np.int64))], ["key", "c"])

    return emit


def _places(kind: Kind):
    def emit(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, _, _, _, _, _, _, _, _, key, doc in scan(kind, batch.column("text")):
                order = np.lexsort((key, doc))
                k, d = key[order], doc[order]
                new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(k1[a + d[new]]), pa.array(k2[a + d[new]])], ["key", "k1", "k2"])

    return emit


ROWS = "key long, proof long, kind int, k1 long, k2 long, at int, lo int, hi int, many int, context binary"


def _rows(key, proof, what, k1, k2, at, lo, hi, many, context):
    n = len(key)
    i32 = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), n))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.broadcast_to(np.asarray(proof, np.int64), n)), i32(what), pa.array(k1), pa.array(k2), i32(at), i32(lo), i32(hi), i32(many), context if context is not None else pa.nulls(n, pa.binary())], ["key", "proof", "kind", "k1", "k2", "at", "lo", "hi", "many", "context"])


def _contexts(kind: Kind):
    def emit(batches):
        seen: dict[tuple[int, int], bool] = {}  # hot windows of this task, and whether their count went on
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            lists = batch.column("keys")
            wanted, flags = lists.flatten().field("key").to_numpy(), lists.flatten().field("hot").to_numpy(zero_copy_only=False)
            wanted, at = np.unique(wanted, return_index=True)
            flags = flags[at]
            for a, own, values, start, end, bounds, t, lo, hi, key, doc in scan(kind, batch.column("text")):
                place = np.searchsorted(wanted, key).clip(max=max(0, len(wanted) - 1))
                known = wanted[place] == key
                hot = known & flags[place]
                sel = np.flatnonzero(known & ~hot)
                for part in np.array_split(sel, 1 + len(sel) // 8000):
                    if len(part):
                        d = doc[part]
                        context = gather(own, start[t[part] - hi[part]], end[t[part] - lo[part] + kind.n - 1])
                        yield _rows(key[part], 0, CONTEXT, k1[a + d], k2[a + d], t[part] - bounds[d], lo[part], hi[part], 0, context)
                sel = np.flatnonzero(hot)
                if not len(sel):
                    continue
                reps = hi[sel] - lo[sel] + 1
                back = np.repeat(hi[sel], reps) - (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
                begin, d = np.repeat(t[sel], reps) - back, np.repeat(doc[sel], reps)
                name, proof = Rolling(values, BASE_A).of(begin, kind.n).view(np.int64), Rolling(kind.proofs(own, values, start, end), BASE_B).of(begin, kind.n).view(np.int64)
                order = np.lexsort((begin, proof, name))
                new = np.append(True, (name[order][1:] != name[order][:-1]) | (proof[order][1:] != proof[order][:-1]))
                group = np.cumsum(new) - 1
                size = np.bincount(group)
                head = order[new]
                at = begin - bounds[d]
                windows = list(zip(name[head].tolist(), proof[head].tolist()))
                known = np.fromiter((w in seen for w in windows), bool, len(windows))
                first = np.flatnonzero(~known)
                if len(first):
                    h = head[first]
                    yield _rows(name[h], proof[h], WINDOW, k1[a + d[h]], k2[a + d[h]], at[h], 0, 0, np.minimum(size[first], 2), None)
                    seen.update((windows[i], many > 1) for i, many in zip(first.tolist(), size[first].tolist()))
                again = [i for i in np.flatnonzero(known).tolist() if not seen[windows[i]]]
                if again:
                    h = head[again]
                    yield _rows(name[h], proof[h], COUNTED, k1[a + d[h]], k2[a + d[h]], 0, 0, 0, 1, None)
                    seen.update((windows[i], True) for i in again)
                twice = order[(size[group] > 1) | known[group]]
                if len(twice):  # decided here: as runs of starts
                    twice = np.sort(twice)
                    s, dd = at[twice], d[twice]
                    cut = np.append(True, (s[1:] != s[:-1] + 1) | (dd[1:] != dd[:-1]))
                    first, last = s[cut], s[np.append(cut[1:], True)]
                    dd = dd[cut]
                    yield _rows(k1[a + dd] * 31 + first, 0, DECIDED, k1[a + dd], k2[a + dd], first, first, last + kind.n, 0, None)

    return emit


Resolver = Callable[[Kind, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def starts_to_spans(kind: Kind, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token and end token of each run of hits; hit[row, a]: the window that starts ``a`` before the anchor."""
    pad = np.zeros((len(hit), 1), np.int8)
    change = np.diff(np.hstack([pad, hit.astype(np.int8), pad]), axis=1)
    row, near = np.nonzero(change == 1)
    far = np.nonzero(change == -1)[1] - 1
    return row, at[row] - far, at[row] - near + kind.n


def _resolve(kind: Kind, resolver: Resolver):
    def spans(names: dict[str, np.ndarray], context: pa.Array):
        what = names["kind"]
        out = []
        sel = np.flatnonzero(what == CONTEXT)
        if len(sel):
            key = names["key"][sel]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            sel = sel[count[inverse] > 1]
        if len(sel):
            data, offsets = text_buffers(context.take(pa.array(sel)))
            hit = resolver(kind, data, offsets, names["lo"][sel].astype(np.int64), names["hi"][sel].astype(np.int64))
            row, first, last = starts_to_spans(kind, hit, names["at"][sel].astype(np.int64))
            out.append((names["k1"][sel][row], names["k2"][sel][row], first, last))
        sel = np.flatnonzero((what == WINDOW) | (what == COUNTED))
        if len(sel):
            order = sel[np.lexsort((names["proof"][sel], names["key"][sel]))]
            k, p = names["key"][order], names["proof"][order]
            group = np.cumsum(np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))) - 1
            yes = order[(np.bincount(group, names["many"][order])[group] > 1) & (what[order] == WINDOW)]
            out.append((names["k1"][yes], names["k2"][yes], names["at"][yes].astype(np.int64), names["at"][yes].astype(np.int64) + kind.n))
        sel = np.flatnonzero(what == DECIDED)
        if len(sel):
            out.append((names["k1"][sel], names["k2"][sel], names["lo"][sel].astype(np.int64), names["hi"][sel].astype(np.int64)))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def emit(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(parts: list[pa.RecordBatch]):
            whole = pa.Table.from_batches(parts).combine_chunks()
            if whole.num_rows:
                found = spans({n: whole.column(n).to_numpy() for n in whole.column_names if n != "context"}, whole.column("context").combine_chunks() if whole.num_rows else None)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int64)), pa.array(found[3].astype(np.int64))], ["k1", "k2", "first", "last"])

        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):  # sorted by key; a key is never cut
            held.append(batch)
            size += batch.nbytes
            if size > CHUNK:
                key = batch.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from flush([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    size = held[0].nbytes * (len(key) - cut) // len(key)
        if held:
            yield from flush(held)

    return emit


def covered(docs: DataFrame, kind: Kind, resolver: Resolver, hot: int = HOT) -> DataFrame:
    """k1, k2 and the spans of tokens covered by windows that occur elsewhere too.

    ``docs`` has k1, k2 and text (``keyed``) and any columns the caller needs
    later: all of them go through the join that finds the contexts, so that a
    later join of the same ``docs`` with the spans reuses its exchange and the
    texts are shuffled once.
    """
    p = partitions(docs.sparkSession)
    texts = docs.select(*KEY, "text")
    repeated = docs.select("text").mapInArrow(_keys(kind), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key", (F.col("c") > hot).alias("hot"))
    places = texts.mapInArrow(_places(kind), "key long, k1 long, k2 long")
    wanted = places.join(repeated, "key").groupBy(*KEY).agg(F.collect_list(F.struct("key", "hot")).alias("keys"))
    contexts = docs.join(wanted, KEY).mapInArrow(_contexts(kind), ROWS)
    found = contexts.repartition(p, "key").sortWithinPartitions("key").mapInArrow(_resolve(kind, resolver), "k1 long, k2 long, first long, last long")
    return found.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(spans, KEY, "left").select("doc_id", "text", F.transform("spans", lambda s: s["first"]).alias("first"), F.transform("spans", lambda s: s["last"]).alias("last"))


def cover(n: int, first, last) -> np.ndarray:
    """Which of n tokens the spans cover."""
    if first is None or not len(first):
        return np.zeros(n, bool)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.asarray(first), 1)
    np.add.at(edges, np.asarray(last), -1)
    return np.cumsum(edges)[:n] > 0
