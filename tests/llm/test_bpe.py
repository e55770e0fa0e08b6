"""BPE against the tokenizers library and exact round trips."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietframe.llm import bpe
from quietframe.llm.queries import vocabulary


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    plain.no_truncation()
    plain.no_padding()
    with open(vocabulary(), encoding="utf-8") as f:
        return bpe.Codec(f.read()), plain


PIECES = st.sampled_from(["a", "aaaa", "the", " the", "'s", "'ll", "\n", "\n\n", " ", "    ", "é", "日本", "12", "345", "!?", "<|endoftext|>", "x" * 40, " ", "\t", "🙂", "__", "ab" * 30])


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECES, max_size=120))
def test_joined_halves_are_the_whole(pair, parts):
    codec, plain = pair
    text = "".join(parts)
    want = plain.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    if "<|endoftext|>" not in text:
        assert codec.encode(text, leaf=40) == want
    assert codec.decode(want) == plain.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "abc ", " ", "\n ", "é", "0", "-=", "thequickbrown", "日本語"])
def test_long_unsplit_text(pair, unit):
    codec, plain = pair
    text = unit * 3000
    with ThreadPoolExecutor(2) as pool:
        assert codec.encode(text, leaf=500, pool=pool) == plain.encode(text, add_special_tokens=False).ids


def test_long_random_letters(pair):
    codec, plain = pair
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeéñ") for _ in range(20000))
    assert codec.encode(text, leaf=300) == plain.encode(text, add_special_tokens=False).ids


def test_table(spark, pair):
    _, plain = pair
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "é <|endoftext|> x"), (3, "w " * 50000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_documents(df, vocabulary()).collect()), key=str)
    want = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), vocabulary()).collect() == []
