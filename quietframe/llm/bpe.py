"""Byte-level BPE encoding and decoding by tree concatenation.

A text longer than a leaf is cut in halves, these in halves again, down to
leaves of at most ``LEAF`` characters, wherever the cuts fall: inside words too,
so that a long stretch without any split is no harder than other text.  Leaves
are encoded in parallel threads (the encoder runs outside the interpreter's
lock).  Then neighbours are joined, up the tree: a window around each join is
encoded again and grown until its tokens agree exactly with the tokens of the
left and of the right side.  A sequence is the encoding of its text if every
pair of neighbouring tokens is, so one agreeing token on either side carries
over; the window asks for ``AGREE`` of them, and goes on to the whole where no
smaller window agrees.

Defined cases: null and empty text have no tokens and decode to the empty
string; repeated rows are encoded each; the decoded text of valid UTF-8 is the
text itself.
"""

from __future__ import annotations

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import documents

#: Characters that are encoded at once.
LEAF = 1 << 12
#: Threads of a worker that encode leaves.
THREADS = 2
#: First reach, in characters, of the window around a join.
REACH = 64
#: Tokens that have to agree on each side of a join.
AGREE = 3

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_codecs: dict[str, "Codec"] = {}
_pools: dict[int, ThreadPoolExecutor] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte of each printable stand-in of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary in the format of the tokenizers library."""

    def __init__(self, spec: str):
        import tiktoken

        model = json.loads(spec)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.size = np.zeros(max([*ranks.values(), *special.values()], default=0) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        for token, i in special.items():
            self.size[i] = len(token.encode())

    def plain(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all")

    def encode(self, text: str, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
        if len(text) <= leaf:
            return self.plain(text)
        many = 1 << (-(-len(text) // leaf) - 1).bit_length()
        cuts = [len(text) * i // many for i in range(many + 1)]
        parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        encoded = list((pool.map if pool else map)(self.plain, parts))
        while len(parts) > 1:
            pairs = range(0, len(parts), 2)
            encoded = [self.joined(parts[i], encoded[i], parts[i + 1], encoded[i + 1]) for i in pairs]
            parts = [parts[i] + parts[i + 1] for i in pairs]
        return encoded[0]

    def joined(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The encoding of left + right from those of its parts; bytes are counted from the join."""
        reach = REACH
        while reach < min(len(left), len(right)):
            before, after = left[-reach:], right[:reach]
            window = self.plain(before + after)
            size = len(before.encode())
            starts = np.cumsum(np.append(0, self.size[window])) - size
            near, next_ = left_ids[-size - 1 :], right_ids[: len(after.encode()) + 1]  # all that the window can hold
            left_starts = -np.cumsum(self.size[near[::-1]])[::-1]
            right_starts = np.cumsum(np.append(0, self.size[next_]))[:-1]
            a = self._agreement(starts, window, dict(zip(left_starts.tolist(), near)), False)
            b = self._agreement(starts, window, dict(zip(right_starts.tolist(), next_)), True)
            if a is not None and b is not None:
                head = len(left_ids) - len(near) + int(np.searchsorted(left_starts, a)) if a < 0 else len(left_ids)
                inner = [t for s, t in zip(starts[:-1].tolist(), window) if a <= s < b]
                return [*left_ids[:head], *inner, *right_ids[int(np.searchsorted(right_starts, b)) :]]
            reach *= 2
        return self.plain(left + right)

    def _agreement(self, starts: np.ndarray, window: list[int], half: dict[int, int], right: bool) -> int | None:
        """Byte at which ``AGREE`` neighbouring tokens of the window that are the half's own end."""
        run = 0
        for start, end, token in zip(starts[:-1].tolist(), starts[1:].tolist(), window):
            inside = start >= 0 if right else end <= 0
            run = run + 1 if inside and half.get(start) == token else 0
            if run == AGREE:
                return end
        return None

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", "replace")


def leaf_pool() -> ThreadPoolExecutor:
    """The threads of this process (a forked worker makes its own)."""
    if os.getpid() not in _pools:
        _pools.clear()
        _pools[os.getpid()] = ThreadPoolExecutor(THREADS)
    return _pools[os.getpid()]


def codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; no shuffle.

    ``vocabulary``: path of a byte-level BPE file of the tokenizers library, read
    once on the driver and broadcast (its size does not depend on the documents).
    ``with_ids`` adds the ids and the decoded text themselves.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def digests(batches):
        bpe = codec(spec.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "", pool=leaf_pool())
                raw = np.asarray(ids, "<u4").tobytes()
                decoded = bpe.decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(raw).hexdigest())
                rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    rows[3].append(ids)
                    rows[4].append(decoded)
            out = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return documents(df, id_col, text_col).mapInArrow(digests, SCHEMA + (", ids array<long>, decoded string" if with_ids else ""))
