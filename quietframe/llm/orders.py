"""Sorted orders of suffixes with common prefixes, and the longest match of each suffix with another one."""

from __future__ import annotations

import numpy as np


def range_min(values: np.ndarray):
    """A function that gives the least of values[i:j] for arrays i < j (a sparse table: a level for each power of two)."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    starts = np.append(0, np.cumsum([len(v) for v in levels]))
    flat = np.concatenate(levels) if len(values) else values

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        return np.minimum(flat[starts[level] + i], flat[starts[level] + j - (1 << level)])

    return least


def sorted_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of the rows of a matrix of whole numbers below 2**32, and the common prefix of each with the row before it in that order."""
    rows, width = matrix.shape
    padded = np.zeros((rows, width + width % 2), np.uint64)
    padded[:, :width] = matrix
    columns = (padded[:, ::2] << np.uint64(32)) | padded[:, 1::2]
    order = np.lexsort(columns.T[::-1]) if columns.shape[1] else np.arange(rows)
    ranked = matrix[order]
    common = np.zeros(rows, np.int64)
    if rows > 1 and width:
        differ = ranked[1:] != ranked[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    elif rows > 1:
        common[1:] = width
    return order, common


def positions(order: np.ndarray) -> np.ndarray:
    """The rank of each element of an order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def longest_right(head: np.ndarray, rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes given by the class of their head and the rank of what follows it: the longest common stretch after the head with another suffix of the same head; -1 if there is none.

    Sorted by head and rank, the suffixes are in corpus order, so that the best
    match of each is one of its two neighbours.  ``common`` holds the common
    prefixes of neighbours in the order of ranks.
    """
    out = np.full(len(head), -1, np.int64)
    if len(head) < 2:
        return out
    order = np.argsort(head * (len(common) + 1) + rank, kind="stable")
    same = np.flatnonzero(head[order[1:]] == head[order[:-1]])
    before, after = order[same], order[same + 1]
    match = range_min(common)(rank[before] + 1, rank[after] + 1)
    out[before] = match
    out[after] = np.maximum(out[after], match)
    return out


def distinct_strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of ``length`` bytes at ``start`` in lexicographic order, as one of their places each, and the rank of every string.

    The bytes themselves are compared; a shorter string comes before those it begins.
    """
    width = int(length.max(initial=0))
    matrix = np.zeros((len(start), width + 3), np.uint8)
    for i in range(width):
        some = np.flatnonzero(length > i)
        matrix[some, i] = data[start[some] + i]
    matrix[:, width], matrix[:, width + 1], matrix[:, width + 2] = length >> 16, (length >> 8) & 255, length & 255
    _, first, inverse = np.unique(matrix.view(f"V{width + 3}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


def suffix_ranks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix array of a dictionary by prefix doubling: for each byte of the strings data[offsets[i]:offsets[i+1]] the rank of the rest of its string among all such rests; equal rests have equal ranks."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the end of the string
    have = 7
    key = np.minimum(left, have).astype(np.uint64)
    padded = np.append(data, np.zeros(have, np.uint8)).astype(np.uint64)
    for i in range(have):
        key |= np.where(left > i, padded[i : n + i], np.uint64(0)) << np.uint64(8 * (have - i))
    _, rank = np.unique(key, return_inverse=True)
    longest = int(left.max())
    while have < longest:
        more = left > have
        second = np.zeros(n, np.int64)
        second[more] = rank[np.flatnonzero(more) + have] + 1
        _, rank = np.unique(rank * np.int64(n + 2) + second, return_inverse=True)
        have *= 2
    return rank
