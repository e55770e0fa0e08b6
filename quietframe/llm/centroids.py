"""Centroid clustering (Lloyd's rounds) of vectors of whole numbers, exact to the last digit.

Components become whole numbers, floor(scale * x).  Squared distances of a block
of vectors to all centroids are |x|^2 - 2 x.c + |c|^2 by a matrix product in
float64; as long as no sum of absolute values on the way reaches 2**53, every
step of it is exact whatever the order of additions.  Rows beyond that bound are
taken by whole numbers: 64 bits below 2**62, Python's own beyond.  Each task
adds the vectors of its blocks up by centroid; ``treeAggregate`` combines these
sums, a few numbers a task, in several levels.  Nothing else is moved: there is
no shuffle by cluster, so a vector or cluster with a third of all rows is no
harder than others, and a lost executor's tasks are simply run again.

The table is read once for the first centroids, once a round, once for the
inertia and once for the result; centroids travel with the tasks (``k`` times
``dims`` numbers).

Defined cases: rows whose vector is null, of another length, or has a null, NaN
or infinite component are left out; repeated rows and identifiers count as often
as they come; a null identifier counts as the empty text when the first
centroids are drawn; fewer than ``k`` vectors make fewer centroids, none make no
rows; of equal centroids the first gets the vectors, and a centroid without any
stays where it is; equal hashes are ordered by the vector.  Distances and sums beyond the range of a
long, which only components beyond 10**8 or so can have, are given as its
largest value; which centroid is nearest stays exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches

#: Whole numbers below it are exact in float64.
EXACT = 1 << 53
#: Below it sums of 64-bit numbers can not overflow.
WIDE = 1 << 62
#: Largest long.
TOP = (1 << 63) - 1
#: Vectors of a block: with 64 dimensions 2 MB of float64.
BLOCK = 4096

SCHEMA = "vec_id long, cluster int, distance long"


def kept(df: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array of doubles) of the rows with ``dims`` components, all there and finite."""
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where((F.size("vector") == dims) & F.forall("vector", finite))


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch of vectors, as whole numbers in float64 (a power of two as scale loses nothing)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(flat.reshape(-1, dims) * float(scale))


def as_integers(rows: np.ndarray) -> np.ndarray:
    """Whole numbers in float64 as Python's own."""
    return np.array([[int(v) for v in row] for row in rows.tolist()], object).reshape(rows.shape)


def bound_of(largest_x: np.ndarray, largest_c: int, dims: int) -> np.ndarray:
    """What no partial sum of |x|^2 + 2 |x.c| + |c|^2 exceeds, for rows by their largest component."""
    x = largest_x.astype(np.float64)
    return dims * (x + float(largest_c)) ** 2 * (1 + 2.0**-40)


def squares_to(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """|x|^2 - 2 x.c + |c|^2 for every row and centroid, in the arithmetic of what is given."""
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ centroids.T) + (centroids * centroids).sum(1)[None, :]


@dataclass(frozen=True)
class Centroids:
    """Centroids as tuples of Python's whole numbers."""

    rows: tuple[tuple[int, ...], ...]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid and the squared distance to it (objects where longs are too short) of each row of ``x``; of equally near ones the smallest number."""
        n, dims = x.shape
        largest = max((abs(v) for row in self.rows for v in row), default=0)
        bound = bound_of(np.abs(x).max(axis=1, initial=0.0), largest, dims)
        cluster, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        beyond: dict[int, int] = {}
        for lowest, limit in ((-1.0, EXACT), (EXACT, WIDE), (WIDE, float("inf"))):
            at = np.flatnonzero((bound >= lowest) & (bound < limit)) if limit != float("inf") else np.flatnonzero(bound >= lowest)
            if not len(at):
                continue
            if limit == EXACT:
                d = squares_to(x[at], np.array(self.rows, np.float64))
            elif limit == WIDE:
                d = squares_to(x[at].astype(np.int64), np.array(self.rows, np.int64))
            else:
                d = squares_to(as_integers(x[at]), np.array(self.rows, object).reshape(len(self.rows), dims))
            best = d.argmin(axis=1)
            cluster[at] = best
            least = d[np.arange(len(at)), best]
            if limit == float("inf"):
                beyond.update(zip(at.tolist(), least.tolist()))
            else:
                distance[at] = least.astype(np.int64)
        if not beyond:
            return cluster, distance
        exact = distance.astype(object)
        exact[list(beyond)] = list(beyond.values())
        return cluster, exact

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def added(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[list, list]:
    """How many rows each centroid has and their sum by component, exactly."""
    counts = np.bincount(cluster, minlength=k).tolist()
    if np.abs(x).max(initial=0.0) * max(len(x), 1) < EXACT:
        hits = (cluster[None, :] == np.arange(k)[:, None]).astype(np.float64)
        return counts, [[int(v) for v in row] for row in (hits @ x).tolist()]
    whole_rows = as_integers(x)
    return counts, [[sum(column) for column in whole_rows[cluster == j].T.tolist()] if counts[j] else [0] * x.shape[1] for j in range(k)]


def combined(a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
    """Two partial sums as one."""
    return [p + q for p, q in zip(a[0], b[0])], [[p + q for p, q in zip(s, t)] for s, t in zip(a[1], b[1])]


def blocks(batches, dims: int, scale: int):
    """Identifiers and whole vectors of blocks of at most ``BLOCK`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part.column(0), whole(part.column(1), dims, scale)


def first_centroids(rows: DataFrame, k: int, scale: int, seed: str) -> Centroids:
    """The ``k`` vectors whose identifiers, after ``seed``, have the smallest SHA-256."""
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = rows.select(name.alias("name"), "vector").orderBy("name", "vector").limit(k).collect()
    return Centroids(tuple(tuple(int(v) for v in np.floor(np.array(r["vector"], np.float64) * float(scale)).tolist()) for r in drawn))


def summed(rows: DataFrame, centroids: Centroids, dims: int, scale: int, distances: bool = False) -> tuple[list, list]:
    """Counts and sums of the vectors of each centroid; with ``distances`` the sum of squared distances stands for that of the vectors."""
    k = len(centroids.rows)
    width = 1 if distances else dims
    zero = ([0] * k, [[0] * width for _ in range(k)])

    def partial(batches):
        total = zero
        for _, x in blocks(batches, dims, scale):
            cluster, distance = centroids.nearest(x)
            if distances:
                own = [distance[cluster == j].tolist() for j in range(k)]
                total = combined(total, ([len(v) for v in own], [[sum(v)] for v in own]))
            else:
                total = combined(total, added(x, cluster, k))
        numbers = [*total[0], *(v for row in total[1] for v in row)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in numbers]], pa.list_(pa.string()))], ["numbers"])

    def numbers_of(row) -> tuple[list, list]:
        flat = [int(v) for v in row["numbers"]]
        return flat[:k], [flat[k + j * width : k + (j + 1) * width] for j in range(k)]

    parts = rows.mapInArrow(partial, "numbers array<string>").rdd
    return parts.treeAggregate(zero, lambda total, row: combined(total, numbers_of(row)), combined, depth=3)


def fit(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> Centroids:
    """Centroids after ``rounds`` rounds over the kept rows; each becomes the floor of the mean of its vectors."""
    now = first_centroids(rows, k, scale, seed)
    for _ in range(rounds if now.rows else 0):
        counts, sums = summed(rows, now, dims, scale)
        now = Centroids(tuple(tuple(s // n for s in total) if n else old for old, n, total in zip(now.rows, counts, sums)))
    return now


def assign(rows: DataFrame, centroids: Centroids, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster and squared distance of every kept row; no shuffle."""

    def nearest(batches):
        for ids, x in blocks(batches, dims, scale):
            cluster, distance = centroids.nearest(x)
            within = np.minimum(distance, TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(within)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, SCHEMA)


def of_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every kept row with its cluster, distance, the inertia of its cluster and of all, and the digest of its centroid."""
    rows = kept(df, dims, id_col, vector_col)
    centroids = fit(rows, k, rounds, dims, scale, seed)
    if not centroids.rows:
        none = df.sparkSession.createDataFrame([], f"{SCHEMA}, cluster_inertia long, inertia long, centroid_sha256 string")
        return none
    counts, sums = summed(rows, centroids, dims, scale, distances=True)
    own = [min(s[0], TOP) for s in sums]
    every = min(sum(s[0] for s in sums), TOP)
    out = assign(rows, centroids, dims, scale)
    return out.select(
        "vec_id", "cluster", "distance", of_cluster(own, "long").alias("cluster_inertia"), F.lit(every).cast("long").alias("inertia"),
        of_cluster([centroids.digest(j) for j in range(len(centroids.rows))], "string").alias("centroid_sha256"),
    )
