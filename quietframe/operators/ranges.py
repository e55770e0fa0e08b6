"""Groups in ranges: rows sorted by keys and an order, dealt out evenly whatever the sizes of groups.

A range partitioning by keys and order puts small groups whole into one
partition and cuts large ones between several.  What has to be known across a
cut, such as how much a group has before it, comes from a summary of the first
and the last group of each partition: two rows a partition on the driver,
however many rows and groups there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quietframe.operators.grouped import named
from quietframe.sources.shared import in_place


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before it; null equals null."""
    now, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    differ = pc.fill_null(pc.not_equal(now, before), False)
    return pc.or_(differ, pc.xor(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a sorted table begin."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    edge = np.zeros(table.num_rows, bool)
    edge[0] = True
    for c in keys:
        edge[1:] |= changes(table.column(c).combine_chunks())
    return np.flatnonzero(edge)


@dataclass(frozen=True)
class Piece:
    """A group's rows in one partition, of a group that others have rows of too: how many pieces come before, the summaries of all, and what was made once for the group."""

    number: int
    summaries: tuple[Any, ...]
    once: Any = None

    first = property(lambda self: self.number == 0)
    last = property(lambda self: self.number == len(self.summaries) - 1)

    @property
    def before(self) -> tuple[Any, ...]:
        return self.summaries[: self.number]


class SortedGroups:
    """A table in ranges of ``keys`` and ``order``, written once; null comes first.

    ``summary`` takes the rows of a group in a partition and gives a list of whole
    numbers as text, or floats' hexadecimal forms: whatever a later pass needs to
    know about the group's other pieces.  ``once`` makes something of the summaries
    of a group that is cut, such as a noisy limit, of which there may be only one.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], summary: Callable[[pa.Table], list[str]], once: Callable[[tuple[Any, ...]], Any] | None = None):
        self.keys = list(keys)
        by = [named(c).asc_nulls_first() for c in [*keys, *order]]
        self.rows = in_place(rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by))
        self._pieces = self._cut(summary, once)

    def _cut(self, summary: Callable[[pa.Table], list[str]], once: Callable[[tuple[Any, ...]], Any] | None) -> dict[tuple[int, int], Piece]:
        """The pieces of groups that are cut, by partition and whether it is the partition's first group (0) or its last one (1)."""
        keys = self.keys
        fields = [self.rows.schema[c] for c in keys]
        schema = StructType([StructField("part", IntegerType()), StructField("place", IntegerType()), StructField("groups", LongType()), StructField("numbers", ArrayType(StringType())), *fields])

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            table = pa.Table.from_batches(held) if held else None
            if table is None or not table.num_rows:
                return
            starts = group_starts(table, keys)
            bounds = [*starts.tolist(), table.num_rows]
            places = [0] if len(starts) == 1 else [0, 1]
            first = [bounds[0], bounds[-2]][: len(places)]
            rows = [table.slice(bounds[0], bounds[1] - bounds[0]), table.slice(bounds[-2], bounds[-1] - bounds[-2])][: len(places)]
            part = TaskContext.get().partitionId()
            columns = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array([len(starts)] * len(places)), pa.array([summary(r) for r in rows], pa.list_(pa.string()))]
            columns += [table.column(c).combine_chunks().take(pa.array(first)) for c in keys]
            yield pa.RecordBatch.from_arrays(columns, ["part", "place", "groups", "numbers", *keys])

        found = sorted(self.rows.mapInArrow(ends, schema).collect(), key=lambda r: (r["part"], r["place"]))
        runs: list[list] = []
        for r in found:
            key = tuple(r[4:])
            if runs and runs[-1][-1][0] == key and runs[-1][-1][1]["part"] != r["part"]:
                runs[-1].append((key, r))
            else:
                runs.append([(key, r)])
        pieces = {}
        for run in runs:
            if len(run) > 1:
                summaries = tuple(tuple(r["numbers"]) for _, r in run)
                made = once(summaries) if once is not None else None
                for i, (_, r) in enumerate(run):
                    pieces[r["part"], r["place"]] = Piece(i, summaries, made)
        return pieces

    @property
    def any_cut(self) -> bool:
        return bool(self._pieces)

    def map(self, f: Callable[[pa.Table, np.ndarray, dict[int, Piece]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
        """f(rows of a partition, where groups begin, the pieces by number of group) for each partition."""
        keys, pieces = self.keys, self.rows.sparkSession.sparkContext.broadcast(self._pieces)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            table = pa.Table.from_batches(held) if held else None
            if table is None or not table.num_rows:
                return
            starts, part = group_starts(table, keys), TaskContext.get().partitionId()
            own = {number: pieces.value[part, place] for place, number in ((0, 0), (1, len(starts) - 1)) if (part, place) in pieces.value}
            yield from f(table, starts, own)

        return self.rows.mapInArrow(one, schema)


def key_columns(table: pa.Table, keys: Sequence[str], rows: np.ndarray) -> list[pa.Array]:
    """The key columns of some rows."""
    return [table.column(c).combine_chunks().take(pa.array(rows)) for c in keys]


def within(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums of values from the start of their group, with the own value."""
    total = np.cumsum(values)
    sizes = np.diff(np.append(starts, len(values)))
    return total - np.repeat(total[starts] - values[starts], sizes)
