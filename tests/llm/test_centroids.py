"""Centroids against whole-number arithmetic without any shortcut."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietframe.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
TOP = 2**63 - 1


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    now = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(now)), key=lambda j: (far(v, now[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(now)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                now = [*now[:j], tuple(sum(x) // len(mine) for x in zip(*mine)), *now[j + 1 :]]
    out = [(i, nearest(v), v) for i, v in kept]
    dist = [far(v, now[c]) for _, c, v in out]
    total = [sum(d for d, (_, c, _) in zip(dist, out) if c == j) for j in range(len(now))]
    return sorted(((-1 if i is None else i), c, min(d, TOP), min(total[c], TOP), min(sum(total), TOP), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (i, c, _), d in zip(out, dist))


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(queries.op12_centroids(spark, folder)) == brute(rows)


def test_rows_that_are_left_out_and_clashing_columns(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, good[:63]), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (6, [*good[:63], float("-inf")]), (None, [-0.01] * 64), (7, good * 2)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("vector", "cluster", "distance", "name")])
    got = found(centroids.cluster(df))
    assert got == brute(rows) and [r[0] for r in got] == [-1, 1]


def test_ties_repeated_rows_and_empty_clusters(spark):
    rows = [(i % 5, [float(i % 2)] * 64) for i in range(40)] + [(100 + i, [0.5] * 64) for i in range(3)]
    got = found(centroids.cluster(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert len({r[1] for r in got}) < 16  # equal centroids: only the first has rows


def test_empty_table(spark):
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.columns == COLUMNS and empty.collect() == []


@pytest.mark.parametrize("size", [1e5, 3e6, 1e9, 1e30])
def test_beyond_exact_floats(spark, size):
    """Near 2**53, between it and longs, and beyond longs: rows of all three kinds side by side."""
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=64) * (size if i % 3 else 1.0)).tolist()) for i in range(60)]
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_the_bound_decides_who_takes_a_row():
    c = centroids.Centroids(((3,) * 64, (2**24,) * 64))
    x = np.array([[1.0] * 64, [2.0**30] * 64, [2.0**80] * 64])
    cluster, distance = c.nearest(x)
    exact = [min((sum((int(a) - b) ** 2 for a, b in zip(row, center)), j) for j, center in enumerate(c.rows)) for row in x.tolist()]
    assert cluster.tolist() == [j for _, j in exact] and distance.tolist() == [d for d, _ in exact]
    assert centroids.bound_of(np.array([2.0**23]), 2**22, 64)[0] > centroids.EXACT
