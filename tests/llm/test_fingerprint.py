"""Fingerprints against a plain version, and estimates against exact values."""

import base64
import hashlib
import random
import re
import struct

import pyarrow as pa

from quietframe.llm import fingerprint as fp


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), " ".join(rng.choice("aé bcdñ") * rng.randrange(1, 5) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 300)))) for _ in range(n)]
    return rows + [(5, None), (6, ""), (7, "one"), (8, "one two three four"), (8, "a second text of one identifier"), (None, "no identifier")]


WORD = 1 << 64
A, B, C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x5851F42D4C957F2D


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 % WORD
    x ^= x >> 29
    x = x * 0x94D049BB133111EB % WORD
    return x ^ (x >> 32)


def polynomial(values, base):
    return mixed((sum(v * pow(base, k, WORD) for k, v in enumerate(values)) + C) % WORD)


def sketch(text):
    """By the definition, one number at a time."""
    words = [polynomial([mixed((b + 1) * B % WORD) for b in w.encode()], B) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    hashes = sorted({mixed(polynomial(s, A)) for s in shingles})
    return [h for h in hashes if h < WORD // fp.SCALE] or hashes[:1]


def similar(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else float(len(x) == len(y))


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    write = lambda s: base64.b64encode(struct.pack(f"<{len(s)}Q", *s)).decode()
    out = []
    for i, (d, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        own, other, after = sketch(t), sketch(e), sketch(n)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), write(own), write(other), similar(own, other), similar(own, after)))
    return out


def exact(x, y):
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    a, b = shingles(x.split()), shingles(y.split())
    return len(a & b) / len(a | b) if a or b else 1.0


def test_error_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = fp.fingerprints(docs, with_text=True).collect()
    errors = sorted(abs(r.near_edited - exact(texts[r.doc_id], r.edited)) for r in rows)
    assert sum(errors) / len(errors) < 0.05 and errors[len(errors) * 95 // 100] < 0.15
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(150_000))
    rows = fp.fingerprints(spark.createDataFrame([(1, text), (2, "short text of six words here")], "doc_id long, text string")).collect()
    assert [r.n_chars for r in sorted(rows)] == [len(text), 28]


def test_whole_table(spark):
    rows = rows_of(120)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(5)
    got = [tuple(r)[:7] for r in fp.fingerprints(df).collect()]
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_single_document_is_its_own_next(spark):
    row = fp.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row.near_next == 1.0


def test_empty(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_follow_the_truth():
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**9)}" for _ in range(20000)]
    part = base[5000:9000]
    a, b = fp.sketches(pa.array([" ".join(base), " ".join(part)]))
    near, inside = fp.likeness(a, b)
    assert abs(near - 0.2) < 0.03 and inside > 0.98
    assert abs(len(a) - 20000 / fp.SCALE) < 300


def test_round_trip_and_merge():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in (3, 5, 6, 7, 9, 30, 400)]
    sketches = fp.sketches(pa.array(texts))
    for s in sketches:
        assert (fp.read_sketch(fp.written(s)) == s).all()
    for k in range(1, len(texts) + 1):
        every = sorted({h for t in texts[:k] for h in [mixed(polynomial([polynomial([mixed((b + 1) * B % WORD) for b in w.encode()], B) for w in t.split()[i : i + 5]], A)) for i in range(max(1, len(t.split()) - 4))]})
        assert fp.merged(*sketches[:k]).tolist() == ([h for h in every if h < WORD // fp.SCALE] or every[:1])


def test_rank_among(spark):
    from pyspark.sql import functions as F

    limits = [3, 7, 8, 20, 21, 22, 90]
    got = {r.id: r.k for r in spark.range(100).select("id", fp.rank_among(F.col("id"), limits).alias("k")).collect()}
    assert got == {i: sum(x <= i for x in limits) for i in range(100)}
