"""Token files against the tokenizers library, and codes against their definition."""

import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quietframe.llm import queries, token_files
from quietframe.llm.frames import folder

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def brute(plain, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found(df):
    return [tuple(r) for r in df.orderBy(F.col("start")).collect()]


def test_whole_table(spark, plain):
    where = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{where}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert found(queries.op13_token_files(spark, where)) == brute(plain, rows)


def test_nulls_ties_long_texts_clashing_columns(spark, plain):
    long_word, text = "ab" * 30_000, "Some words, and <|endoftext|> within it.\n" * 4000
    rows = [(None, "nobody's"), (1, None), (2, ""), (3, " \n\t"), (4, long_word), (5, text), (6, "same"), (6, "same"), (7, "é é ΟΔΟΣ İ")]
    df = spark.createDataFrame(rows[::-1], SCHEMA).select("*", *[F.lit(9).alias(c) for c in ("tie", "ids", "part", "start", "n_tokens")])
    assert found(token_files.round_trip(df, queries.vocabulary("word_bpe_49k.json"))) == brute(plain, rows)


def test_rows_of_one_identifier_are_in_the_order_of_their_hashes(spark, plain):
    texts = [f"text {i}" for i in range(30)]
    by = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    got = found(token_files.round_trip(spark.createDataFrame([(8, t) for t in texts], SCHEMA), queries.vocabulary("word_bpe_49k.json")))
    assert got == brute(plain, [(8, t) for t in sorted(texts, key=by.get)])


def test_empty_table_and_ids_themselves(spark, plain):
    path = queries.vocabulary("word_bpe_49k.json")
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), path).collect() == []
    where = folder(spark)
    token_files.write(spark.createDataFrame([(1, "a b c"), (2, "b")], SCHEMA), where, path)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, where, with_ids=True).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, "a b c"), (2, "b"))}


def test_other_vocabularies_are_encoded_by_whole_texts(spark):
    path = queries.vocabulary()
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        assert not token_files.encoder(f.read()).pieces
    rows = [(1, " two  words"), (2, "<|endoftext|> x"), (3, None)]
    assert found(token_files.round_trip(spark.createDataFrame(rows, SCHEMA), path)) == brute(own, rows)


PIECES = st.sampled_from(["a", "The", "isn't", "<|endoftext|>", "<|start", "oftext|>", " ", "\n", "\x0b", " ", " ", "é", "́", "ΣΑΣ", "日本", "12", "'s", "!?", "🙂", "\x1c", "x" * 40])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_pieces_are_the_whole(plain, parts):
    import pyarrow as pa

    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        own = token_files.encoder(f.read())
    assert own.pieces
    texts = ["".join(parts), None, "".join(parts[::-1])]
    ids, bounds = own.encode(pa.array(texts), 1)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1]


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=200))
def test_code_lengths(counts):
    n = np.array(counts)
    free = token_files.code_lengths(n, 60)
    assert int((n * free).sum()) == huffman_cost(counts)  # without a limit that matters: Huffman's own cost
    for longest in (8, 10):
        lengths = token_files.code_lengths(n, longest)
        assert lengths.max() <= longest and (2.0 ** -lengths).sum() == 1.0
        assert int((n * lengths).sum()) >= huffman_cost(counts)


def best_limited(counts, longest):
    """Least cost over all complete codes, by trying how many symbols each depth has."""
    counts = sorted(counts, reverse=True)

    def search(i, depth, slots):
        if i == len(counts):
            return 0
        if depth > longest or slots * 2 ** (longest - depth) < len(counts) - i:
            return float("inf")
        return min(depth * sum(counts[i : i + here]) + search(i + here, depth + 1, 2 * (slots - here)) for here in range(min(slots, len(counts) - i) + 1))

    return search(0, 1, 2)


def test_limited_codes_are_the_best():
    draw = random.Random(1)
    for _ in range(60):
        counts = [draw.choice([1, 2, 3, 50, 1000]) for _ in range(draw.randint(2, 8))]
        lengths = token_files.code_lengths(np.array(counts), 3)
        assert int((np.array(counts) * lengths).sum()) == best_limited(counts, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=1400), max_size=6))
def test_blocks_of_bits(docs):
    ids = np.array([i for d in docs for i in d], np.int64)
    known, n = np.unique(ids, return_counts=True)
    book = token_files.Codebook(known, token_files.code_lengths(n, 6))
    sizes = np.array([len(d) for d in docs], np.int64)
    blocks, bits_at, bits = book.write(ids, np.append(0, np.cumsum(sizes)))
    each = token_files.block_sizes(sizes, blocks)
    assert book.read(bits, bits_at, each).tolist() == ids.tolist()
    for k in range(len(each)):  # any block on its own
        assert book.read(bits, bits_at[k : k + 1], each[k : k + 1]).tolist() == ids[each[:k].sum() : each[: k + 1].sum()].tolist()
