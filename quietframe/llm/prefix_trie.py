"""The trie of common beginnings of conversations, by the Cartesian tree of their LCP array.

Conversations become sequences of digests (128 bits of a SHA-256 over role and
text, 16 bytes a turn) and counts of words; texts go no further.  Sorted by
their digests, and by identifier where these are equal, they are dealt into
ranges, one block of the array a range.  ``LCP[i]`` is how many turns
conversation i has in common with the one before it.  Every node of the trie is
an interval of the order: the node of depth d around i reaches from the last
smaller value of the LCP array on its left to the first one on its right.

* A first pass gives each block's first and last sequence and least LCP value.
  The values at the joins of blocks and these block minima, a few numbers a
  block, are all that the driver sees.
* In each block all nearest smaller values are found; positions of equal value
  under the same ones are one node of the Cartesian tree.  A node that begins and
  ends in the block is complete: its members, children, leaves and sums come from
  prefix sums and range minima over its interval.  Depths at which nothing
  branches or ends are not in the tree; they are put in again between a
  node and its parent.
* A node that crosses a join is an open interval of every block it touches,
  at most one a depth at each join.  Its owner is the block where it begins: the
  nearest one on the left whose minimum is smaller than its depth.  Blocks give
  partial sums for (owner, depth), which Spark adds up.

``saved_tokens`` needs no node's whole count: summed over a subtree, members times
words is the words of all its members' further turns, and this less the words of
each node once is what sharing saves.

Identifiers of members are hashed in order as a stream, in the block or, for open
nodes, by one task a node that holds nothing but the state of the hash (SHA-256
can not be taken in parts).

Defined cases: turns in order of ``turn``, null first, equal ones by their
digests; repeated rows are repeated turns; null role or text is empty; rows
without conv_id belong to no conversation and are left out; remainders are
taken as non-negative ones; a conversation without turns left is a member of the
root alone; no conversations make no rows.  A conversation is one row of 20 bytes a turn, and a task
holds the digests of its range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, partitions, small_batches
from .orders import range_min
from .textcore import text_buffers

NOTHING = hashlib.sha256(b"").hexdigest()
#: Kinds of rows of a block: complete nodes, parts of open nodes, members that end at an open node.
NODE, PART, END = 0, 1, 2
ROWS = "kind int, block int, owner int, depth long, conv_id long, parent_conv_id long, parent_owner int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(df: DataFrame, share: Column | None = None, most: int = 3, group: int = 20) -> DataFrame:
    """conv_id, sequence (binary, 16 bytes a turn) and words (array) of every rebuilt conversation.

    The first ``share`` turns (by default unsigned crc32 of the identifier, modulo
    4; ``most`` at most) are those of the conversation whose identifier is the next multiple of
    ``group`` below, or all of these if it has fewer; the others are its own.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 if share is None else share
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)  # no two turns have the same
    turns = small_batches(df).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(marked, 256), 1, 32).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("turn")
    )
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    own = own.select("conv_id", "turns", F.least(share, F.lit(most)).cast("int").alias("h"), base.alias("base"))
    heads = turns.where(F.pmod("conv_id", F.lit(group)) == 0).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list("turn")).alias("first"))
    none = F.array().cast("array<struct<turn:bigint,digest:string,words:int>>")
    both = own.join(heads.select("base", F.slice("first", 1, most).alias("first")), "base", "left")
    both = both.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("sequence"), F.col("turns.words").alias("words"))


class Block:
    """Sorted conversations of one range: identifiers, digests of turns and words."""

    def __init__(self, batches):
        ids, data, sizes, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            bytes_, offsets = text_buffers(batch.column(1))
            data.append(bytes_)
            sizes.append(np.diff(offsets) // 16)
            words.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.turns = np.concatenate(data).view(np.uint64).reshape(-1, 2)
        self.first = np.append(0, np.cumsum(self.size))
        self.words = np.append(0, np.cumsum(np.concatenate(words)))  # of all turns before
        self.n = len(self.ids)

    def raw(self, i: int) -> bytes:
        return self.turns[self.first[i] : self.first[i + 1]].tobytes()

    def inner(self) -> np.ndarray:
        """LCP values of all conversations but the first."""
        both = np.minimum(self.size[:-1], self.size[1:])
        step = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
        a, b = np.repeat(self.first[: self.n - 1], both) + step, np.repeat(self.first[1 : self.n], both) + step
        differ = np.flatnonzero((self.turns[a] != self.turns[b]).any(1))
        pair, at = np.unique(np.repeat(np.arange(len(both)), both)[differ], return_index=True)
        out = both.copy()
        out[pair] = step[differ[at]]
        return out

    def until(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of conversations i."""
        return self.words[self.first[i] + depth] - self.words[self.first[i]]


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b)) // 16
    x, y = (np.frombuffer(v, np.uint64)[: 2 * n].reshape(-1, 2) for v in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each position the last one before it and the first one after it with a smaller value (-1 and the length where there is none), and the first of the equal values between these."""
    n = len(values)
    left, right, same, stack = [-1] * n, [n] * n, list(range(n)), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[same[stack.pop()]] = i
        if stack and values[stack[-1]] == v:
            j = stack.pop()
            same[i], left[i] = same[j], left[j]
        else:
            left[i] = stack[-1] if stack else -1
        stack.append(i)
    for i in range(n):
        right[i] = right[same[i]]
    return left, right, same


class Blocks:
    """What is known of all blocks: LCP values at their first conversations and least values (the first block's is -1)."""

    def __init__(self, numbers: list[int], joins: list[int], least: list[int]):
        self.at = {b: i for i, b in enumerate(numbers)}
        self.numbers, self.joins, self.least = numbers, [*joins, -1], least
        self.before = nearest_smaller(least)[0]

    def of(self, block: int) -> tuple[int, int, list[int]]:
        """LCP values at a block's first conversation and at the next block's, and the owners of the nodes of depth 0, 1, ... that are open on its left."""
        i = self.at[block]
        owners, j = [], i - 1
        for depth in range(self.joins[i], -1, -1):
            while self.least[j] >= depth:
                j = self.before[j]
            owners.append(self.numbers[j])
        return self.joins[i], self.joins[i + 1], owners[::-1]


def summaries(batches):
    """First and last sequence of a block and the least LCP value inside."""
    block = Block(batches)
    if block.n:
        least = int(block.inner().min(initial=np.iinfo(np.int64).max))
        yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [block.raw(0)], "last": [block.raw(block.n - 1)], "least": [least]})


def known_blocks(ordered: DataFrame) -> Blocks:
    """The driver gets a row a range."""
    rows = sorted(ordered.mapInArrow(summaries, "block int, first binary, last binary, least long").collect(), key=lambda r: r["block"])
    joins = [-1, *(common(bytes(a["last"]), bytes(b["first"])) for a, b in zip(rows[:-1], rows[1:]))][: len(rows)]
    return Blocks([r["block"] for r in rows], joins, [min(j, r["least"]) for j, r in zip(joins, rows)])


def ends_of(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


class Output:
    """Rows of a block in the columns of ``ROWS``."""

    def __init__(self, block: int):
        self.block, self.parts = block, []

    def add(self, kind: int, n: int, **columns) -> None:
        values = {"owner": -1, "depth": 0, "conv_id": 0, "parent_conv_id": None, "parent_owner": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None} | columns
        kinds = {"owner": pa.int32(), "parent_owner": pa.int32(), "ends_sha256": pa.string()}
        arrays = [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, self.block), pa.int32())]
        for name, v in values.items():
            as_ = kinds.get(name, pa.int64())
            v = pa.nulls(n, as_) if v is None else np.full(n, v) if np.ndim(v) == 0 else v
            arrays.append(v.cast(as_) if isinstance(v, pa.Array) else pa.array(v, as_))
        self.parts.append(pa.RecordBatch.from_arrays(arrays, ["kind", "block", *values]))


def block_rows(block: Block, number: int, known: Blocks, step: int = 1 << 16):
    """Complete nodes, parts of open nodes and ends of open nodes of one block."""
    m = block.n
    v_left, v_right, owners = known.of(number)
    lcp = np.concatenate([[v_left], block.inner(), [v_right]]).astype(np.int64)
    size, out, everyone = block.size, Output(number), np.arange(m)
    total = block.until(everyone, size)
    begun = total - block.until(everyone, np.maximum(lcp[:m], 0))  # words of the nodes that begin at a conversation
    sum_total, sum_begun = np.append(0, np.cumsum(total)), np.append(0, np.cumsum(begun))
    sum_leaf = np.append(0, np.cumsum(lcp[1:] < size))
    least_id = range_min(block.ids)

    left, right, same = (np.array(v, np.int64) for v in nearest_smaller(lcp.tolist()))
    inside = np.arange(1, m)
    closed = (left >= 0) & (right <= m)  # both ends are in the block
    top = inside[(same[1:m] == inside) & closed[1:m]]
    # nodes: intervals with a branching or an end inside them, then conversations of their own
    single = np.flatnonzero(size > np.maximum(lcp[:m], lcp[1:]))
    l = np.concatenate([left[top], single])
    r = np.concatenate([right[top], single + 1])
    depth = np.concatenate([lcp[top], size[single]])
    above = np.where(lcp[l] >= lcp[r], l, r)  # a position of the parent's value that bounds the node
    over = lcp[above]
    go_on, stop = np.bincount(same[inside], size[inside] > lcp[inside], minlength=m + 1), np.bincount(same[inside], size[inside] == lcp[inside], minlength=m + 1)
    children = np.concatenate([go_on[top] + (size[left[top]] > lcp[top]), np.zeros(len(single))]).astype(np.int64)
    ends = np.concatenate([stop[top] + (size[left[top]] == lcp[top]), np.ones(len(single))]).astype(np.int64)
    convs, leaves, own_id = r - l, sum_leaf[r] - sum_leaf[l], least_id(l, r) if len(l) else np.zeros(0, np.int64)
    rest = sum_total[r] - sum_total[l] - (sum_begun[r] - sum_begun[l + 1]) - total[l]
    # the parent: complete too, or open under an owner
    inner_parent = (above > 0) & (above < m) & closed[above]
    at = np.where(inner_parent, above, 0)
    parent_id = least_id(np.where(inner_parent, left[at], 0), np.where(inner_parent, right[at], 1)) if len(l) else own_id
    entered = (np.minimum.accumulate(lcp)[l] >= over) & (over >= 0)  # it comes in from the left: no smaller value up to the node
    parent_owner = np.where(entered, np.array([*owners, number], np.int64)[np.where(entered, over, -1)], number)
    asked = ~inner_parent & (over >= 0)
    for a in range(0, len(l), step):
        s = slice(a, a + step)
        levels = depth[s] - over[s]
        node = np.repeat(np.arange(len(levels)) + a, levels)
        level = over[node] + 1 + np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels)
        bottom, top_level = level == depth[node], level == over[node] + 1
        digests = np.full(len(node), NOTHING, object)
        at = np.flatnonzero(bottom & (ends[node] > 0))
        digests[at] = [ends_of(block.ids[x : x + k]) for x, k in zip(l[node[at]].tolist(), ends[node[at]].tolist())]
        parents = np.where(top_level, parent_id[node], own_id[node])
        unknown = top_level & asked[node]
        out.add(
            NODE, len(node), depth=level, conv_id=own_id[node], parent_conv_id=pa.array(parents, mask=unknown | (level == 0)), parent_owner=pa.array(parent_owner[node].astype(np.int32), mask=~unknown), n_convs=convs[node],
            n_children=np.where(bottom, children[node], 1), n_leaves=leaves[node], saved_tokens=rest[node] - (convs[node] - 1) * block.until(l[node], level - 1 + (level == 0)), ends_sha256=digests.tolist(),
        )
        yield from out.parts
        out.parts = []

    # open nodes: those that enter on the left, and those that begin here and leave on the right
    lowest = int(lcp[:m].min())
    entering = [(d, 0, _first_below(lcp, d), owners[d]) for d in range(v_left + 1)]
    leaving = [(d, _last_below(lcp, d, m), m, number) for d in range(lowest + 1, v_right + 1)]
    for d, a, b, owner in entering + leaving:
        at, starts = slice(a, b), owner == number
        above_owner = None if not starts or d == 0 else number if d - 1 > lowest else owners[d - 1]
        before = int(block.until(np.array([a]), np.array([max(d - 1, 0)]))[0])
        once = int(sum_begun[b] - sum_begun[a]) if not starts else int(sum_begun[b] - sum_begun[a + 1]) + int(total[a]) - before
        child = (lcp[at] <= d) & (size[at] > d)
        out.add(
            PART, 1, owner=owner, depth=d, parent_owner=above_owner, conv_id=int(block.ids[at].min()), n_convs=b - a, n_children=int(child.sum()), n_leaves=int(sum_leaf[b] - sum_leaf[a]),
            saved_tokens=int(sum_total[b] - sum_total[a]) - (b - a) * before - once,
        )
        done = block.ids[at][size[at] == d]
        if len(done):
            out.add(END, len(done), owner=owner, depth=d, conv_id=done)
        if len(out.parts) >= 256:
            yield from _merged(out)
    yield from _merged(out)


def _merged(out: Output):
    if out.parts:
        yield from pa.Table.from_batches(out.parts).combine_chunks().to_batches()
    out.parts = []


def _first_below(lcp: np.ndarray, depth: int) -> int:
    """The first position after the block's first one with a smaller value, or the end."""
    below = lcp[1:] < depth
    return int(below.argmax()) + 1 if below.any() else len(lcp) - 1


def _last_below(lcp: np.ndarray, depth: int, m: int) -> int:
    """The last position of the block with a smaller value."""
    return m - 1 - int((lcp[:m] < depth)[::-1].argmax())


def streamed_ends(rows: DataFrame) -> DataFrame:
    """owner, depth and the digest of the members that end there, from sorted rows that a task takes one after the other."""

    def digests(batches):
        now, state = None, None
        for batch in batches:
            owner, depth, ids = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]))).tolist() if len(ids) else []
            for a, b in zip(edges, [*edges[1:], len(ids)]):
                key, text = (int(owner[a]), int(depth[a])), ",".join(map(str, ids[a:b].tolist()))
                if key == now:
                    state.update(f",{text}".encode())
                    continue
                if now is not None:
                    yield _digest(now, state)
                now, state = key, hashlib.sha256(text.encode())
        if now is not None:
            yield _digest(now, state)

    dealt = rows.select("owner", "depth", "conv_id").repartition(partitions(rows.sparkSession), "owner", "depth").sortWithinPartitions("owner", "depth", "conv_id")
    return dealt.mapInArrow(digests, "owner int, depth long, ends_sha256 string")


def _digest(key: tuple[int, int], state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([state.hexdigest()])], ["owner", "depth", "ends_sha256"])


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, sequence, words)."""
    spark = sequences.sparkSession
    order = ["sequence", "conv_id"]
    ordered = checkpoint(sequences.select("conv_id", "sequence", "words").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    known = spark.sparkContext.broadcast(known_blocks(ordered))

    def rows(batches):
        block = Block(batches)
        if block.n:
            yield from block_rows(block, TaskContext.get().partitionId(), known.value)

    found = checkpoint(ordered.mapInArrow(rows, ROWS))
    parts = found.where(F.col("kind") == PART)
    open_ = parts.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_owner").alias("parent_owner"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    open_ = checkpoint(open_.join(streamed_ends(found.where(F.col("kind") == END)), ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    up = open_.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    parent = F.coalesce("parent_conv_id", "up").alias("parent_conv_id")
    columns = [parent if c == "parent_conv_id" else F.col(c) for c in NODES]
    crossing = open_.withColumn("parent_conv_id", F.lit(None).cast("long")).join(up, ["parent_owner", "depth"], "left").select(*columns)
    # complete nodes ask their own block's part of an open parent, so that no parent of many blocks is a hot key
    here = parts.select("block", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth")).join(up, ["parent_owner", "depth"])
    nodes = found.where(F.col("kind") == NODE)
    settled = nodes.where("parent_owner is null").select(*NODES)
    asked = nodes.where("parent_owner is not null").join(here, ["block", "parent_owner", "depth"]).select(*columns)
    return settled.unionByName(asked).unionByName(crossing)


def shared_prefixes(df: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations of a table of turns (conv_id, turn, role, text)."""
    return trie(rebuilt(df))
