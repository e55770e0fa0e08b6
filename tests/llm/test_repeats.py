"""Byte and word dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietframe.llm import orders, repeats, substring_dedup, suffix_dedup
from quietframe.llm.repeats import Kind


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "be", "çà", "dog", "ñu", "Word", "zeta", "x" * 9]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(40):
        body = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            cut = rng.randrange(len(body) + 1)
            a, b = sorted(rng.sample(range(61), 2))
            body[cut:cut] = passage[a:b]
        docs.append(rng.choice([" ", "\n", "  "]).join(body))
    docs += [docs[3], docs[3], None, "", " ", "aaaa" * 100, "ab " * 150, docs[0] + " tail", "\x00" * 90, "y" + "\x00" * 70]
    return list(enumerate(docs)) + [(3, docs[3]), (3, "other text"), (None, docs[5])]


def windows_gone(tokens, n):
    """tokens: list of sequences; for each the flags of covered tokens."""
    count = Counter(t[i : i + n] for t in tokens for i in range(len(t) - n + 1))
    out = []
    for t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def spans(gone):
    return sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))


@pytest.mark.parametrize("hot", [10**9, 1])
@pytest.mark.parametrize("n", [20, 50])
def test_bytes(spark, n, hot):
    rows = corpus(n)
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, gone in zip(rows, texts, windows_gone(texts, n)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(i, len(t), sum(gone), spans(gone), hashlib.sha256(kept).hexdigest())] += 1
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, did int, tag string").repartition(3)
    assert Counter(map(tuple, suffix_dedup.dedup(df, n, hot=hot).collect())) == want


@pytest.mark.parametrize("hot", [10**9, 1])
@pytest.mark.parametrize("n", [6, 12])
def test_words(spark, n, hot):
    rows = corpus(n)
    texts = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    want = Counter()
    for (i, _), t, gone in zip(rows, texts, windows_gone(texts, n)):
        kept = " ".join(w for w, g in zip(t, gone) if not g)
        want[(i, len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, did int, tag string").repartition(3)
    assert Counter(map(tuple, substring_dedup.dedup(df, n, hot=hot).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(df).collect() == []
    assert substring_dedup.dedup(df).collect() == []


def test_rewrite_keeps_columns_and_characters(spark):
    text = "é" * 150
    df = spark.createDataFrame([(1, text, "en", 150), (2, "x" + text + "y", "fr", 152), (3, None, "de", 0)], "doc_id long, text string, lang string, n_chars long")
    out = suffix_dedup.rewrite(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "", "en", 0), (2, "xy", "fr", 2), (3, "", "de", 0)]


def test_very_long_text(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(1_200_000))
    df = spark.createDataFrame([(1, text + text[700_000:700_500])], "doc_id long, text string")
    row = suffix_dedup.dedup(df).first()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (1_200_500, 1000, 2)


def contexts(kind, alphabet, separator, seed=3):
    """Blocks of one anchor each, many of which share passages: bytes, offsets, lo, hi, and the flags that counting gives."""
    rng = random.Random(seed)
    base = [rng.choice(alphabet) for _ in range(400)]
    blocks, lo, hi = [], [], []
    for _ in range(300):
        h = rng.randrange(kind.reach)
        low = rng.randrange(h + 1)
        start = rng.randrange(340)
        block = base[start : start + h + kind.n - low]
        if rng.random() < 0.5:
            block[rng.randrange(len(block))] = rng.choice(alphabet)
        if len(block) == h + kind.n - low:
            blocks.append(block), lo.append(low), hi.append(h)
    count = Counter((a, tuple(b[h - a : h - a + kind.n])) for b, low, h in zip(blocks, lo, hi) for a in range(low, h + 1))
    want = {(i, a) for i, (b, low, h) in enumerate(zip(blocks, lo, hi)) for a in range(low, h + 1) if count[a, tuple(b[h - a : h - a + kind.n])] > 1}
    whole = [separator.join(b) for b in blocks]
    return np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)]), np.array(lo), np.array(hi), want


@pytest.mark.parametrize("alphabet,n", [(b"ab", 12), (b"a", 12), (b"abcdefgh", 30), (b"ab\0", 20)])
@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_orders_and_factors_find_what_counting_finds(module, alphabet, n):
    words = module is substring_dedup
    kind = Kind("word", n, n * 2 // 3, 1, 16) if words else Kind("byte", n, n * 4 // 5, max(1, n // 8), 4)
    letters = [(bytes([c]) * 2).replace(b"\0", b"c") if words else bytes([c]) for c in alphabet]
    data, offsets, lo, hi, want = contexts(kind, letters, b" " if words else b"")
    hit = module.resolve(kind, data, offsets, lo, hi)
    assert set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(hit))))) == want


def test_suffix_ranks():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(40))) for _ in range(30)]
    offsets = np.cumsum([0, *map(len, strings)])
    rank = orders.suffix_ranks(np.frombuffer(b"".join(strings), np.uint8), offsets)
    suffixes = [s[i:] for s in strings for i in range(len(s))]
    place = {s: i for i, s in enumerate(sorted(set(suffixes)))}
    assert rank.tolist() == [place[s] for s in suffixes]


def index_of(blocks, lo, hi):
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for b in blocks for w in b])
    return substring_dedup.Index(ids, np.cumsum([0, *map(len, blocks)]), np.array(hi), np.array(lo))


def test_the_greedy_parse_decides(monkeypatch):
    """Only where the parse stands is looked up: not inside a factor, and at its boundary again."""
    n = 6
    one = list("abcdefghijklmnop")
    blocks = [one, ["x", *one[1:9], "y", *"zzzzzz"], ["v", "v", "v", *one[3:]]]  # anchors 5 words after the start
    index, asked = index_of(blocks, [0, 0, 0], [5, 5, 5]), []
    plain = substring_dedup.Index.match
    monkeypatch.setattr(substring_dedup.Index, "match", lambda self, rows, a: asked.extend((r, a) for r in rows.tolist()) or plain(self, rows, a))
    hit = substring_dedup.factors(index, n)
    # block 0: nothing at 5, words 1..8 are a factor of 8 words with the windows 4, 3 and 2, whose boundary is window 1 (held by block 2)
    assert [a for r, a in asked if r == 0] == [5, 4, 1]
    assert np.flatnonzero(hit[0]).tolist() == [0, 1, 2, 3, 4] and np.flatnonzero(hit[1]).tolist() == [2, 3, 4] and np.flatnonzero(hit[2]).tolist() == [0, 1, 2]


def test_a_broken_parser_breaks_the_query(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    kind = substring_dedup.kind(35)
    data, offsets, lo, hi, want = contexts(Kind("word", 12, 8, 1, 16), [b"a", b"b"], b" ")
    assert want and substring_dedup.resolve(Kind("word", 12, 8, 1, 16), data, offsets, lo, hi).any()
    monkeypatch.setattr(substring_dedup, "factors", lambda index, n: np.zeros((len(index.hi), int(index.hi.max()) + 1), bool))
    assert not substring_dedup.resolve(Kind("word", 12, 8, 1, 16), data, offsets, lo, hi).any()
    assert kind.n == 35 and text


def test_a_hot_window_has_two_rows_a_task_at_most():
    """One passage in many texts of many batches: a task sends its windows once, and once more that there are others."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef") for _ in range(400))
    kind = suffix_dedup.kind(200)

    def batch(i):
        texts = ["".join(rng.choice("ghijkl") for _ in range(300)) + passage + "".join(rng.choice("mnopqr") for _ in range(300)) for _ in range(3)]
        column = pa.array(texts)
        keys = np.unique(np.concatenate([x[9] for x in repeats.scan(kind, column)]))
        hot = pa.array([[{"key": int(k), "hot": True} for k in keys]] * len(texts))
        return pa.RecordBatch.from_arrays([pa.array([10 * i + j for j in range(3)]), pa.array([j for j in range(3)]), column, hot], ["k1", "k2", "text", "keys"])

    rows = [r for out in repeats._contexts(kind)(batch(i) for i in range(12)) for r in out.to_pylist()]
    sent = Counter((r["key"], r["proof"]) for r in rows if r["kind"] in (repeats.WINDOW, repeats.COUNTED))
    assert max(sent.values()) <= 2
    single = [r for out in repeats._contexts(kind)(batch(i).slice(0, 1) for i in range(12)) for r in out.to_pylist()]
    sent = Counter((r["key"], r["proof"]) for r in single if r["kind"] in (repeats.WINDOW, repeats.COUNTED))
    assert max(sent.values()) == 2
    decided = sum(r["hi"] - 200 - r["lo"] + 1 for r in single if r["kind"] == repeats.DECIDED)
    assert decided >= 11 * 201  # all later places of the passage's windows


@pytest.mark.parametrize("module,n", [(suffix_dedup, 200), (substring_dedup, 35)])
def test_hot_passages_over_many_batches(spark, module, n):
    """The hot way gives what counting gives, with few rows a batch so that windows are seen again and again."""
    rng = random.Random(9)
    passage = " ".join(str(rng.randrange(1000)) for _ in range(120))
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(40)) + (f" {passage} " if i % 3 else " ") + " ".join(str(rng.randrange(10**6)) for _ in range(40))) for i in range(90)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r.doc_id: r.n_removed for r in module.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens = [t.encode() if n == 200 else tuple(t.split()) for _, t in rows]
    assert got == {i: sum(g) for (i, _), g in zip(rows, windows_gone(tokens, n))}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda data, start, end, other=False: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"ab cd ab abc cd", np.uint8)
    start, end = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 15])
    ids = substring_dedup.word_ids(data, start, end)
    assert ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids.tolist())) == 3


def colliding(spark):
    """Two texts of one 32-bit Spark hash."""
    seen = spark.range(300_000).select(F.concat(F.lit("x" * 300), F.col("id").cast("string")).alias("t")).groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1).first()
    return seen.ts[:2]


def test_rows_of_one_32_bit_hash_keep_their_own_results(spark):
    a, b = colliding(spark)
    rng = random.Random(2)
    unique = "".join(rng.choice("abcdefghij") for _ in range(400))
    rows = [(None, a), (None, b), (None, a), (None, unique), (7, "")]
    got = Counter(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("n_bytes", "n_removed").collect()))
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((len(t), sum(g)) for t, g in zip(texts, windows_gone(texts, 200)))
    assert got == want


@pytest.mark.parametrize("module,n", [(suffix_dedup, 200), (substring_dedup, 35)])
def test_shipped_lengths_on_a_table(spark, module, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokens = [(t or "").encode() if n == 200 else tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    want = {i: sum(g) for (i, _), g in zip(rows, windows_gone(tokens, n))}
    assert {r.doc_id: r.n_removed for r in module.dedup(docs).collect()} == want
    assert sum(want.values()) > 0


def test_very_long_words_text(spark):
    rng = random.Random(6)
    text = [str(rng.randrange(10**9)) for _ in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(text + text[70_000:70_100]))], "doc_id long, text string")
    row = substring_dedup.dedup(df).first()
    assert (row.n_words, row.n_removed) == (200_100, 200)
