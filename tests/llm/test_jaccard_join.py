"""The similarity join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quietframe.llm import jaccard_join
from quietframe.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and 100 * n >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 or not rows:
            w = [word() for _ in range(rng.randrange(1, 120))]
        elif kind == 1:
            w = [word() for _ in range(rng.randrange(1, 12))] + passage
        elif kind == 2:
            w = passage + [word()]
        else:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 4, "ONE  two"), (None, rows[0][1]), (None, None)]
    return rows


@pytest.mark.parametrize("often,block", [(50, 2000), (3, 7)])
def test_against_all_pairs(spark, monkeypatch, often, block):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rows = corpus(often, 160)
    df = spark.createDataFrame([(d, t, 9, "z") for d, t in rows], "doc_id long, text string, sid int, size string").repartition(3)
    assert Counter(map(tuple, jaccard_join.join(df, block=block).collect())) == brute(rows)


def test_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(13)]  # 9 shingles, one more on each side: 8 of 10 in common
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base[:-1]][1:] + ["y"])), (3, " ".join(base[:9] + ["q"]))]
    assert Counter(map(tuple, jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_tree_prunes_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    groups = [np.unique(np.concatenate([rng.choice(base, 250, replace=False), rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(70)]
    groups.sort(key=len)
    size = np.array([len(g) for g in groups])
    bits = jaccard_join.signatures(np.concatenate(groups), np.append(0, np.cumsum(size)))
    tree = jaccard_join.Tree(size, np.arange(len(size)), bits)
    found = set(zip(*(v.tolist() for v in tree.pairs(tree, 80))))
    for i, x in enumerate(groups):
        for j, y in enumerate(groups):
            n = len(np.intersect1d(x, y))
            if i < j and 100 * n >= 80 * (len(x) + len(y) - n):
                assert (i, j) in found


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(5, 3), (3, 5), (7, 7), (3, -2)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 20 for i in range(20, 41)} | {5: -2, 3: -2, -2: -2}


def test_prefix_length_is_exact_for_small_sets():
    assert jaccard_join.prefix_length(10, 10) == 3
    assert jaccard_join.prefix_length(500, 0) == 101
    assert jaccard_join.prefix_length(1000, 1000) < 40


@pytest.mark.parametrize("rounds", [(2,), (1, 2)])
def test_rounds_before_the_last_change_no_result(spark, rounds):
    """The trees alone find all links; the exact prefix gives the same."""
    rows = corpus(11, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.join(df, block=9, rounds=rounds, exact=len(rounds) == 1).collect())) == brute(rows)


def test_a_family_of_near_copies_and_a_hot_text(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):  # chains: neighbours are alike, the ends are not
        base[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, "the same text of some words for many rows") for i in range(1500)] + [(5000, " ".join(f"z{i}" for i in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, jaccard_join.join(df, block=16).collect())) == brute(rows[:120]) + Counter({(1000 + i, 5, 1000): 1 for i in range(1500)}) + Counter({(5000, 59_996, 5000): 1})


def test_representatives_of_null_identifiers(spark):
    texts = [f"some words of text number {i} that differ from all other ones by their number {i * 7}" for i in range(30)]
    rows = [(None, t, i) for i, t in enumerate(texts + texts[:5])] + [(None, None, 99), (None, "", 98)]
    kept = jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string, k1 int")).collect()
    assert sorted(r.text or "" for r in kept) == sorted(texts + ["", ""])
