"""The trie of conversations against one built of dictionaries."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for conv in turns:
        own, base = ([t[2:] for t in sorted(turns.get(c, []))] for c in (conv, conv - conv % 20))
        h = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = base[:h] + own[h:]
    members = collections.defaultdict(list)
    for conv, sequence in whole.items():
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(conv)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * words
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, folder)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_shared_beginnings_and_equal_conversations(spark, seed):
    draw = random.Random(seed)
    rows = []
    for conv in range(80):
        for turn in range(draw.choice([1, 2, 3, 4, 6])):
            rows.append((conv, turn, draw.choice(["user", "user", None]), draw.choice(["a b", "a b", "a b c", None])))
    draw.shuffle(rows)
    assert found(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_long_texts_clashing_columns(spark):
    rows = [(20, None, "user", "first of all"), (20, 0, None, None), (20, 1, "user", "word " * 50_000), (21, 5, "", ""), (41, 0, "user", "x"), (None, 0, "user", "y")]
    rows += [(60, 3, "user", "again"), (60, 3, "user", "again")]  # a repeated row is a repeated turn
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(0).alias(c) for c in ("sequence", "words", "block", "depth", "base")])
    assert found(prefix_trie.shared_prefixes(df)) == brute(rows)


def test_ties_are_in_the_order_of_digests(spark):
    rows = [(0, 1, "user", t) for t in "abcd"]
    digest = lambda t: hashlib.sha256(f"4:user{t}".encode()).hexdigest()[:32]
    settled = [(0, i, "user", t) for i, t in enumerate(sorted("abcd", key=digest))]
    assert found(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(settled)


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced by none
    rows = [(lone, 0, "user", "gone")]
    got = found(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_blocks_cut_anywhere():
    """Open nodes of any cuts add up to the nodes of the whole."""
    draw = random.Random(5)
    letter = lambda c: hashlib.md5(c.encode()).digest()
    for _ in range(150):
        rows = sorted((b"".join(letter(draw.choice("ab")) for _ in range(draw.choice([0, 1, 2, 3, 3, 5]))), i) for i in range(draw.randint(1, 16)))
        cuts = sorted(draw.sample(range(1, len(rows)), min(len(rows) - 1, draw.randint(0, 5)))) if len(rows) > 1 else []
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batch = lambda p: pa.RecordBatch.from_arrays([pa.array([i for _, i in p]), pa.array([s for s, _ in p], pa.binary()), pa.array([[1] * (len(s) // 16) for s, _ in p], pa.list_(pa.int32()))], ["a", "b", "c"])
        blocks = [prefix_trie.Block([batch(p)]) for p in parts]
        joins = [-1, *(prefix_trie.common(a[-1][0], b[0][0]) for a, b in zip(parts[:-1], parts[1:]))]
        known = prefix_trie.Blocks(list(range(len(parts))), joins, [min(j, int(b.inner().min(initial=99))) for j, b in zip(joins, blocks)])
        made = [r for i, b in enumerate(blocks) for out in prefix_trie.block_rows(b, i, known) for r in out.to_pylist()]
        want = collections.Counter(s[: 16 * d] for s, _ in rows for d in range(len(s) // 16 + 1))
        open_ = collections.Counter()
        for r in made:
            if r["kind"] == prefix_trie.PART:
                open_[r["owner"], r["depth"]] += r["n_convs"]
        got = [(r["depth"], r["n_convs"]) for r in made if r["kind"] == prefix_trie.NODE] + [(d, n) for (_, d), n in open_.items()]
        assert sorted(got) == sorted((len(s) // 16, n) for s, n in want.items())
