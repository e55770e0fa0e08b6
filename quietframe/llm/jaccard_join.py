"""Similarity join of word-shingle sets by signature trees.

Equal sets are one class with one representative.  The others stand in groups:
by a global order of shingles (rare ones by hash, then the most frequent ones)
two sets of Jaccard similarity ``t`` have one of their first
``floor((1-t) n) + 1`` shingles in common, and the sets that share one are a
group.  Groups of the same members are one group.

Each group is searched by signature trees, which alone propose pairs.  Nodes
hold the OR of their sets' bitmaps, the range of set sizes and the largest
excess of size over bits.  A dual traversal prunes two nodes when the size
ranges are too far apart, when the maximum possible overlap (common bits plus
excess) is too small for any pair, or when all their sets are in one component.
So that a family of copies is never expanded into pairs, there are three rounds,
each followed by the exact comparison of the pairs' whole texts and by the
components of all links so far:

1. of a set's pairs that survive the trees of all its groups, the one with the
   set that shares most shingles with others (the original among its copies);
2. of a set's pairs with other components, the one of the largest possible
   similarity;
3. every pair with another component that was not compared before.

The third round makes the result exact; the first two leave it little to do and
change no result.  A group of more than ``BLOCK`` sets is searched by blocks.  In
the first two rounds a block holds its own sets and the group's first one.  In
the third, sets of the group's largest component are only held against those of
others, so that a set is copied once for each block of smaller components.

By the order of shingles alone two linked sets could miss each other where a set
gives fewer shingles than the exact number: it gives ``k`` where the chance of a
miss is below ``r**k``, with ``r`` the largest share of its shingles that may
differ, and ``k`` is chosen for ``MISS`` = 2**-56 a pair, the odds of equal
64-bit hashes, on which classes rest anyway.  ``exact`` asks for the full
number.

Defined cases: null and empty texts have no shingles and are linked with
nothing; a text of fewer words than a shingle is one shingle; a null identifier
is never the smallest; repeated rows get a row each; an empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import KEY, checkpoint, free_shuffles, keyed, partitions, with_hot_keys, with_row
from .orders import positions
from .textcore import U64, Rolling, ascii_lower, mix, runs, text_buffers, word_hashes, words

SHINGLE = 5
PERCENT = 80
MISS = 56 * math.log(2)
#: The most frequent shingles that are put last in the order, and the count from which one is.
FREQUENT, OFTEN = 50_000, 50
BLOCK = 1000
LEAF = 16
BITS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document, and the documents' offsets into them."""
    data = ascii_lower(data)
    start, end, bounds = words(data, offsets)
    values = word_hashes(data, start, end)
    count = np.diff(bounds)
    roll = Rolling(values)
    whole = roll.all(size)
    doc = np.repeat(np.arange(len(count)), count)
    inside = doc[: len(whole)] == doc[size - 1 :] if len(whole) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.concatenate([whole[inside], roll.of(bounds[short], count[short])])
    d = np.concatenate([doc[: len(whole)][inside], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(count) + 1))


def each_run(column: pa.Array, size: int = SHINGLE):
    data, offsets = text_buffers(column)
    for a, b in runs(offsets):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def prefix_length(n: int, first: int, percent: int = PERCENT, full: bool = False) -> int:
    """How many shingles of a set of ``n``, ``first`` of them not frequent, stand for it."""
    exact = n - -(-percent * n // 100) + 1
    if first and not full:
        share = (100 - percent) * n / percent / first
        if share < 1:
            likely = math.ceil(MISS / -math.log(share))
            if likely <= first:
                return min(exact, likely)
    return exact


def _frequent(df: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, counted over all documents where a batch repeats them; at most FREQUENT of them."""

    def count(batches):
        for batch in batches:
            found = [h for _, _, h, _ in each_run(batch.column("text"), size)]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                some = c > 2
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some].astype(np.int64))], ["token", "c"])

    top = df.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT)
    return np.sort(top.select("token").toArrow().column("token").to_numpy().view(U64))


def profiles(docs: DataFrame, size: int, percent: int, full: bool = False) -> DataFrame:
    """doc_id, k1, k2, the set's identity ``sid``, its size and the shingles that stand for it."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def emit(batches):
        late = frequent.value
        for batch in batches:
            sid, count, tokens = [], [], []
            for a, b, h, bounds in each_run(batch.column("text"), size):
                place = np.searchsorted(late, h).clip(max=max(0, len(late) - 1))
                last = late[place] == h if len(late) else np.zeros(len(h), bool)
                sums = np.append(U64(0), np.cumsum(mix(h ^ U64(0xA0761D6478BD642F))))
                sid.append(mix(sums[bounds[1:]] - sums[bounds[:-1]]))
                count.append(np.diff(bounds))
                for i in range(b - a):
                    own, often = h[bounds[i] : bounds[i + 1]], last[bounds[i] : bounds[i + 1]]
                    n, many = len(own), int(often.sum())
                    k = prefix_length(n, n - many, percent, full) if n else 0
                    tokens.append((np.concatenate([own[~often], own[often]]) if many else own)[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(np.concatenate(sid).view(np.int64)), pa.array(np.concatenate(count).astype(np.int64)), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "sid", "size", "tokens"])

    return docs.select("doc_id", *KEY, "text").mapInArrow(emit, "doc_id long, k1 long, k2 long, sid long, size long, tokens array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""

    def compare(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                one = [h[s:e] for _, _, h, o in each_run(part.column("text_a"), size) for s, e in zip(o[:-1], o[1:])]
                two = [h[s:e] for _, _, h, o in each_run(part.column("text_b"), size) for s, e in zip(o[:-1], o[1:])]
                yes = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(one, two)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    yes[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield part.select(["a", "b"]).filter(pa.array(yes))

    share = max(500, pairs.count() // partitions(pairs.sparkSession))
    # the pairs of a set in the middle of many copies are dealt to several tasks, each with its text; at most twice as many sets as partitions are so
    hot = {side: pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > share).select(F.col(side).alias("often"), F.ceil(F.col("n") / share).cast("int").alias("k")) for side in ("a", "b")}
    for side in hot:
        often = F.broadcast(hot[side])
        spread = F.coalesce("k", F.lit(1))
        copies = texts.join(often, F.col("sid") == F.col("often"), "left").select(F.col("sid").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("copy"))
        dealt = pairs.join(often, F.col(side) == F.col("often"), "left").withColumn("copy", F.pmod(F.xxhash64("a", "b"), spread).cast("int")).drop("often", "k")
        pairs = dealt.join(copies, [side, "copy"]).drop("copy")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


class Tree:
    """Signature tree over sets sorted by size: level 0 are the sets, each node above covers ``LEAF`` nodes below."""

    def __init__(self, size: np.ndarray, label: np.ndarray, bits: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, excess, label, label)]
        while len(self.levels[-1][0]) > LEAF:
            b, lo, hi, ex, l0, l1 = self.levels[-1]
            at = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.minimum.reduceat(l0, at), np.maximum.reduceat(l1, at)))

    def pairs(self, other: "Tree", percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of sets that may be similar and are in different components; x < y if ``other`` is the tree itself."""
        # both trees may differ in height: the lower one's top stands until the other has come down
        a, b = len(self.levels) - 1, len(other.levels) - 1
        x, y = np.divmod(np.arange(len(self.levels[a][0]) * len(other.levels[b][0]), dtype=np.int32), np.int32(len(other.levels[b][0])))
        while True:
            if other is self and a == b:  # each pair once
                once = x < y if a == 0 else x <= y
                x, y = x[once], y[once]
            found = [self._alive(self.levels[a], other.levels[b], x[s : s + 4096], y[s : s + 4096], percent, a == 0 and b == 0) for s in range(0, len(x), 4096)]
            alive = np.concatenate(found) if found else np.zeros(0, bool)
            x, y = x[alive], y[alive]
            if a == 0 and b == 0:
                return x, y
            if a >= b:
                x, y = self._down(x, y, len(self.levels[a - 1][0]))
                a -= 1
            else:
                y, x = self._down(y, x, len(other.levels[b - 1][0]))
                b -= 1

    @staticmethod
    def _down(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        child = (x[:, None] * np.int32(LEAF) + np.arange(LEAF, dtype=np.int32)).ravel()
        y = np.repeat(y, LEAF)
        return child[child < n], y[child < n]

    @staticmethod
    def _alive(p, q, x, y, percent, exact) -> np.ndarray:
        bits, lo, hi, excess, l0, l1 = (v[x] for v in p)
        bits2, lo2, hi2, excess2, m0, m1 = (v[y] for v in q)
        same = (l0 == l1) & (m0 == m1) & (l0 == m0)
        apart = (100 * hi < percent * lo2) | (100 * hi2 < percent * lo)
        common = np.bitwise_count(bits & bits2).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(common + np.minimum(excess, excess2), hi), hi2)
        return ~same & ~apart & ((100 + percent) * most >= percent * (lo + lo2))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bitmap of ``BITS`` bits of each set."""
    n = len(bounds) - 1
    out = np.zeros((n, BITS // 64), U64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    bit = (h >> U64(9)) % U64(BITS)
    np.bitwise_or.at(out, (row, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return out


HEAVY, NEAR, ALL = range(3)


def _proposed(mode: int, c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows (i, j) that survived, those a round asks for: one and other set, and what they are chosen by."""
    sid = c["sid"]
    if mode == ALL:
        return np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), np.zeros(len(i))
    if mode == HEAVY:  # each row with the heaviest one above it
        order = np.lexsort((sid, c["weight"]))
        rank = positions(order)
        best = np.full(len(sid), -1, np.int64)
        np.maximum.at(best, np.where(rank[j] > rank[i], i, j), np.maximum(rank[i], rank[j]))
        one = np.flatnonzero(best >= 0)
        other = order[best[one]]
        return sid[one], sid[other], c["weight"][other].astype(float)
    value = np.empty(len(i), np.float32)
    for s in range(0, len(i), 4096):
        x, y = i[s : s + 4096], j[s : s + 4096]
        value[s : s + 4096] = np.bitwise_count(c["bits"][x] & c["bits"][y]).sum(1) / (c["size"][x] + c["size"][y])
    best = np.full(len(sid), -1, np.float32)
    for side in (i, j):
        np.maximum.at(best, side, value)
    found = [(one[top], other[top]) for one, other in ((i, j), (j, i)) for top in (np.flatnonzero(value == best[one]),)]
    one, other = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((sid[other], sid[one]))
    last = np.append(sid[one][order][1:] != sid[one][order][:-1], True)[: len(order)]
    one, other = one[order[last]], other[order[last]]
    return sid[one], sid[other], best[one].astype(float)


def _search(mode: int, percent: int):
    """Rows sorted by ``cell`` (a block of a group, or two blocks of it) to proposed pairs."""

    def cells(c: dict[str, np.ndarray]):
        order = np.lexsort((c["size"], c["own"], c["cell"]))
        c = {k: v[order] for k, v in c.items()}
        edges = np.append(np.flatnonzero(np.append(True, c["cell"][1:] != c["cell"][:-1])), len(order))
        out = []
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s < 2:
                continue
            first = np.flatnonzero(c["own"][s:e] == c["x"][s]) + s
            second = first if c["x"][s] == c["y"][s] else np.flatnonzero(c["own"][s:e] == c["y"][s]) + s
            if not len(first) or not len(second):
                continue
            trees = [Tree(c["size"][k], c["label"][k], c["bits"][k]) for k in ((first,) if second is first else (first, second))]
            i, j = trees[0].pairs(trees[-1], percent)
            out.append(_proposed(mode, c, first[i], second[j]))
        return [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def emit(batches):
        held, size = [], 0

        def flush(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            columns = {n: whole.column(n).to_numpy() for n in ("cell", "x", "y", "own", "sid", "size", "weight", "label")}
            data, _ = text_buffers(whole.column("bits"))
            columns["bits"] = data.copy().view(U64).reshape(len(columns["sid"]), -1)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cells(columns)], ["a", "b", "value"])

        for batch in batches:  # a cell is never cut
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 8 << 20:
                cell = batch.column("cell").to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))
                if cut:
                    yield flush([*held[:-1], batch.slice(0, cut)])
                    held, size = [batch.slice(cut)], 0
        if held:
            yield flush(held)

    return emit


def proposals(mode: int, member: DataFrame, signature: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) with a < b that a round's tree search proposes; ``member``: token, sid, size, weight and label."""
    p = partitions(member.sparkSession)
    labels = member.groupBy("token", "label").agg(F.count("*").alias("n"), F.max(F.struct("weight", "sid")).alias("top"))
    groups = labels.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("major"), F.max("top").alias("top"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    rows = member.join(groups.select("token", "n", "major", "top"), "token")
    slot = lambda n: F.pmod(F.xxhash64("sid"), F.greatest(n, F.lit(1))).cast("int")
    if mode == ALL:
        less, more = blocks(F.col("n") - F.col("major.n")), blocks(F.col("major.n"))
        minor = F.col("label") != F.col("major.label")
        rows = rows.withColumn("own", F.when(minor, slot(less)).otherwise(less + slot(more)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, less + more).otherwise(less) - 1)))
        rows = rows.select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    else:
        many = blocks(F.col("n"))
        spots = F.when(F.col("sid") == F.col("top.sid"), F.sequence(F.lit(0), many - 1)).otherwise(F.array(slot(many)))
        rows = rows.withColumn("own", F.explode(spots)).select("*", F.col("own").alias("x"), F.col("own").alias("y"))
    rows = rows.join(signature, "sid").select(F.xxhash64("token", "x", "y").alias("cell"), "x", "y", "own", "sid", "size", "weight", "label", "bits")
    found = rows.repartition(p, "cell").sortWithinPartitions("cell").mapInArrow(_search(mode, percent), "a long, b long, value double")
    if mode == ALL:
        return found.select("a", "b").distinct()
    best = found.groupBy("a").agg(F.max(F.struct("value", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, **more) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return classes_of(df, id_col, text_col, size, percent, block, **more).select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each component keeps the one of the smallest identifier; texts without words all stay."""
    classed = classes_of(df, id_col, text_col)
    empty = F.col("size") == 0
    stay = classed.where(empty).select(*KEY, "size").unionByName(classed.where(~empty).select(F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"), F.lit(1).cast("long").alias("size"))).distinct()
    tagged = with_row(df, id_col, text_col)
    kept = tagged.join(stay, KEY).withColumn("own", F.when(empty, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return kept.dropDuplicates([*KEY, "own"]).select("row.*")


def _members(classes: DataFrame) -> DataFrame:
    """token, sid, size and weight of the sets of every group of two sets or more; of groups with the same members one is left."""
    tokens = classes.select(F.explode("tokens").alias("token"), "sid", "size")
    who = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"who{k}") for k in (1, 2)]
    groups = tokens.groupBy("token").agg(F.count("*").alias("n"), *who).where("n > 1").groupBy("n", "who1", "who2").agg(F.min("token").alias("token"))
    member = checkpoint(tokens.join(groups.select("token", "n"), "token"))
    return checkpoint(member.join(member.groupBy("sid").agg(F.sum("n").alias("weight")), "sid").select("token", "sid", "size", "weight"))


def _signatures(texts: DataFrame, size: int) -> DataFrame:
    def signed(batches):
        for batch in batches:
            for a, b, h, bounds in each_run(batch.column("text"), size):
                bits = signatures(h, bounds)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), b - a, [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(a, b - a), rows], ["sid", "bits"])

    return texts.mapInArrow(signed, "sid long, bits binary")


def classes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, rounds: tuple[int, ...] = (HEAVY, NEAR, ALL), exact: bool = False) -> DataFrame:
    """doc_id, k1, k2 and size of every document, and ``least``: doc_id, k1 and k2 of the first document of its component."""
    docs = keyed(df, id_col, text_col)
    every = checkpoint(profiles(docs, size, percent, exact))
    whole = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *KEY)
    classes = every.where("size > 0").groupBy("sid").agg(F.min(F.struct(*KEY)).alias("place"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"), F.min(whole).alias("least"))
    member = _members(classes)

    places = member.select("sid").distinct().join(classes.select("sid", "place"), "sid").select("sid", "place.k1", "place.k2")
    texts = checkpoint(places.join(docs.select(*KEY, "text"), KEY).dropDuplicates(["sid"]).select("sid", "text"))
    signature = checkpoint(_signatures(texts, size))
    free_shuffles(df.sparkSession)

    known = tested = None
    for mode in rounds:
        rows = member.withColumn("label", F.col("sid")) if known is None else member.join(known, F.col("sid") == F.col("node"), "left").select("token", "sid", "size", "weight", F.coalesce("label", "sid").alias("label"))
        pairs = proposals(mode, rows, signature, percent, block)
        pairs = checkpoint(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        free_shuffles(df.sparkSession)
        links = verified(pairs, texts, size, percent)
        known = checkpoint(components(links if known is None else links.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b")))))
        free_shuffles(df.sparkSession)

    # sets first, documents last: a set may have a third of all documents
    labelled = checkpoint(classes.select("sid", "copies", "least").join(known, F.col("sid") == F.col("node"), "left").select("sid", "copies", "least", F.coalesce("label", "sid").alias("class")))
    first = labelled.groupBy("class").agg(F.min("least").alias("least"), F.count("*").alias("sets"))
    of_set = with_hot_keys(labelled.select("sid", "copies", "class"), first, "class", "sets").select("sid", "copies", "least")
    return with_hot_keys(every.select("doc_id", *KEY, "sid", "size"), of_set, "sid", "copies")
