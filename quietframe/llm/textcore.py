"""Vectorised text primitives shared by the operators of this subpackage.

All of them work on Arrow buffers: a batch of texts is one byte array plus
offsets, and tokens, rolling hashes and window hashes are numpy arrays over
that byte array.  No per-character or per-word Python loop is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values; any odd numbers do).
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
#: Bytes of text that one vectorised step takes; bounds its temporaries.
SLICE_BYTES = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[start:end], offsets - start


def runs(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last+1) runs of documents of at most ``limit`` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def powers(n: int, base: int = BASE_A) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, base, U64)
            up[0] = 1
            down = np.full(size, inverse, U64)
            down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 21:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any stretch of a token sequence in constant time."""

    def __init__(self, tokens: np.ndarray, base: int = BASE_A):
        self.n = len(tokens)
        up, self.down = powers(self.n + 1, base)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(tokens.astype(U64, copy=False) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Mixed hashes of tokens[start:start+length]."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + U64(0x5851F42D4C957F2D))

    def all(self, length: int) -> np.ndarray:
        """Mixed hashes of every stretch of ``length`` tokens."""
        if self.n < length:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[: self.n - length + 1]) * self.down[: self.n - length + 1] + U64(0x5851F42D4C957F2D))


#: Random-looking value of each byte, so that small alphabets still fill the word.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE_B))


def is_space(data: np.ndarray) -> np.ndarray:
    """The separators of ``[^\\x20\\x09-\\x0D]+``."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every document, and the word offsets of the documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~is_space(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] |= inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] |= inside[last]
    tail = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tail] |= inside[tail]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; ``other``: by other byte values and another base."""
    if not len(start):
        return np.zeros(0, U64)
    roll = Rolling(mix(BYTE_VALUES)[data], BASE_A) if other else Rolling(BYTE_VALUES[data], BASE_B)
    return roll.of(start, end - start)


def strings_of(data: np.ndarray) -> str:
    return data.tobytes().decode("utf-8", "surrogateescape")


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
