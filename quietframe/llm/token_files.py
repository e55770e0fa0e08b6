"""Token ids in files: canonical Huffman codes of limited length, in blocks that decode on their own.

Every document's ids, with the end id, are written in ascending order of
identifiers.  A first pass encodes all texts once, into a table of packed ids,
and counts the ids (a row a distinct id of each task, summed by Spark).  From the
counts the driver makes a code of at most ``LONGEST`` bits by package-merge: the
work of it depends on the vocabulary alone.  A range partitioning by identifier
then deals the packed ids out in order; its tasks write the bit streams, a batch
of documents at a time.

The files of a folder are:

* ``codes``: id and length of the code of every id that occurs.  Codes are
  canonical: by length, then by id, each one more than the one before, shifted
  to its own length; so lengths say it all.
* ``shards``: rows of ``part`` (range), ``shard`` (number within it), ``before``
  (ids of the part's earlier shards), for each of its documents ``doc_ids``,
  ``n_tokens`` and ``blocks`` (how many), for each block ``bits_at`` (offset of
  its first bit in ``bits``: the checkpoint), and ``bits`` itself.  Documents start at
  whole bytes and are cut into blocks of ``BLOCK`` ids.
* ``parts``: how many ids all earlier parts have (a row a part).

Any block can be decoded without the others.  A reader decodes all blocks of a
shard side by side: one look into a table of 2**LONGEST entries gives an id and
its length for each of them.

A text is cut at white space of ASCII, which no token contains and where no rule
of these tokenizers looks across (the pre-tokenizer drops white space, and no
added token holds any), and between a letter of ASCII and a closing mark after it
(``MARKS``), which are always tokens of their own; the tokenizers library encodes
each distinct piece of a batch once, and a bounded memory of pieces saves repeated
ones.  A vocabulary for which this does not hold is encoded by whole texts instead
(``by_pieces``).

Defined cases: null and empty texts have the end id alone; null identifiers come
first, rows of one identifier in the order of their texts' hashes, and equal rows
stand side by side (they are dealt out by number, so that no range has to take
all of them); no rows make empty tables; a text longer than a batch makes a
shard of its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import documents, folder, partitions, remove
from .textcore import text_buffers

#: Longest code in bits; vocabularies of more than 2**LONGEST ids get as many as they need.
LONGEST = 18
#: Ids of a block.
BLOCK = 512
#: Pieces that a worker remembers.
REMEMBERED = 1_000_000
#: A letter and a closing mark, between which a text can be cut; none of these marks is in a contraction or an added token.
MARKS = r"([A-Za-z])([.,!?;:)\]\"-])"
#: Pieces of one pre-token: letters that lower case and composition leave single letters.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

PACKED = "doc_id long, tie long, n_tokens long, ids binary"
SHARDS = "part int, shard long, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, blocks array<long>, bits_at array<long>, bits binary"


class Encoder:
    """A tokenizer of the tokenizers library, without truncation, padding and added tokens of its own."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_str(spec)
        self.core.no_truncation()
        self.core.no_padding()
        model = json.loads(spec)
        self.pieces = by_pieces(model)
        self.width = "<u2" if self.core.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends = np.zeros(max(self.core.get_vocab().values(), default=0) + 1, bool)
        self.ends[[i for t, i in model["model"]["vocab"].items() if t.endswith(model["model"].get("end_of_word_suffix") or "\0")]] = True
        self.forget()

    def forget(self) -> None:
        """Start anew: ``known`` has the number of each piece, ``first`` and ``flat`` where its ids are and what they are."""
        self.known: dict[str, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Add the ids of new pieces; pieces of one pre-token each are encoded side by side, their last tokens tell them apart."""
        single = [w for w in new if PLAIN.fullmatch(w)]
        other = [w for w in new if not PLAIN.fullmatch(w)]
        parts, sizes = [], []
        for a in range(0, len(single), 1000):
            some = single[a : a + 1000]
            ids = self.plain([" ".join(some)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                other += some
                continue
            parts.append(ids)
            sizes.append(np.diff(np.append(0, ends)))
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
        rest = self.plain(other)
        self.known.update(zip(other, range(len(self.known), len(self.known) + len(other))))
        parts += rest
        sizes.append(np.fromiter((len(v) for v in rest), np.int64, len(rest)))
        self.flat = np.concatenate([self.flat, *parts])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(sizes)))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, each with the end id after it, and where each text's ids start."""
        texts = column.fill_null("").cast(pa.large_string())
        if not self.pieces:
            ids = self.plain(texts.to_pylist())
            bounds = np.append(0, np.cumsum([len(v) + 1 for v in ids])).astype(np.int64)
            out = np.full(bounds[-1], end, np.uint32)
            for at, v in zip(bounds.tolist(), ids):
                out[at : at + len(v)] = v
            return out, bounds
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARKS, r"\1 \2"))
        words = split.flatten().dictionary_encode()
        lists = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[np.asarray(words.indices, np.int64)]
        first = self.first[which]
        many = self.first[which + 1] - first
        before = np.append(0, np.cumsum(many))
        bounds = before[lists] + np.arange(len(lists))
        out = np.full(bounds[-1], end, np.uint32)
        place = np.arange(before[-1])
        document = np.repeat(np.arange(len(lists) - 1), np.diff(before[lists]))
        out[place + document] = self.flat[place + np.repeat(first - before[:-1], many)]
        return out, bounds


def by_pieces(model: dict) -> bool:
    """Whether texts can be cut at ASCII white space: it is dropped by the pre-tokenizer, and neither normalizer nor added token looks across it."""

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else [y for x in part[inner] for y in steps(x, inner)] if part["type"] == "Sequence" else [part]

    known = {"NFC", "Lowercase"}
    normal = all(s["type"] in known or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps(model["normalizer"], "normalizers"))
    cuts = steps(model["pre_tokenizer"], "pretokenizers")
    cuts = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in cuts[1:])
    added = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip")) and not any(c.isspace() for c in t["content"]) for t in model["added_tokens"])
    return normal and cuts and added


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of the best prefix code without any code longer than ``longest``, by package-merge.

    Each round pairs the cheapest items of the last one and puts the symbols back
    in; a symbol's length is how often it is in the first 2n - 2 items of the
    last round.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    assert n <= 1 << longest
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.int64)
    now, rounds = weight, []
    for _ in range(longest - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        by = np.argsort(merged, kind="stable")
        rounds.append(by < n)
        now = merged[by]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in rounds[::-1]:
        symbols = int(single[:take].sum())  # symbols are taken in order of their weight
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes from ids (ascending) and the lengths of their codes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.longest = int(lengths.max(initial=1))
        by = np.lexsort((ids, lengths))
        step = np.int64(1) << (self.longest - lengths[by])
        start = np.append(0, np.cumsum(step))
        size = int(ids.max(initial=0)) + 1
        self.length = np.zeros(size, np.uint64)
        self.code = np.zeros(size, np.uint64)
        self.length[ids[by]] = lengths[by]
        self.code[ids[by]] = start[:-1] >> (self.longest - lengths[by])
        self.table_id = np.zeros(1 << self.longest, np.uint32)
        self.table_length = np.ones(1 << self.longest, np.uint8)
        self.table_id[: start[-1]] = np.repeat(ids[by], step)
        self.table_length[: start[-1]] = np.repeat(lengths[by], step)

    def write(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Blocks of each document, first bit of each block, and the bits; documents start at whole bytes."""
        sizes = np.diff(bounds)
        lengths = self.length[ids].astype(np.int64)
        total = np.append(0, np.cumsum(lengths))
        room = -(-(total[bounds[1:]] - total[bounds[:-1]]) // 8) * 8
        base = np.append(0, np.cumsum(room))
        at = total[:-1] + np.repeat(base[:-1] - total[bounds[:-1]], sizes)
        blocks = -(-sizes // BLOCK)
        number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        bits_at = at[np.repeat(bounds[:-1], blocks) + number * BLOCK]
        words = np.zeros((int(base[-1]) >> 5) + 2, np.uint64)
        if len(ids):
            word = at >> 5
            value = self.code[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - self.length[ids])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return blocks, bits_at, words.astype(">u4").tobytes()[: int(base[-1]) >> 3]

    def read(self, bits: bytes, bits_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of all blocks, one after the other: every step takes one id of each block that has any left."""
        start = np.cumsum(sizes) - sizes
        by = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[by], -np.arange(int(sizes.max(initial=0))), side="left")
        raw = np.frombuffer(bits + bytes(8), np.uint8)
        window = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        at, place = bits_at[by].astype(np.int64), start[by]
        out = np.empty(int(sizes.sum()), np.uint32)
        shift, mask = np.uint64(64 - self.longest), np.int64(7)
        for many in active.tolist():
            p = at[:many]
            seen = (window[p >> 3].astype(np.uint64) << (p & mask).astype(np.uint64)) >> shift
            out[place[:many]] = self.table_id[seen]
            at[:many] += self.table_length[seen]
            place[:many] += 1
        return out


def block_sizes(n_tokens: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """How many ids each block of the documents has."""
    number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.minimum(BLOCK, np.repeat(n_tokens, blocks) - number * BLOCK)


def packed(df: DataFrame, spec: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text, how many ids it has with the end id, and these as little-endian numbers of 16 bits, or 32 for vocabularies beyond."""
    sent = df.sparkSession.sparkContext.broadcast(spec)

    def encode(batches):
        own = encoder(sent.value)
        for batch in batches:
            ids, bounds = own.encode(batch.column("text"), end)
            raw = ids.astype(own.width)
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * raw.itemsize), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.diff(bounds)), data.cast(pa.binary())], ["doc_id", "tie", "n_tokens", "ids"])

    rows = documents(df, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return rows.mapInArrow(encode, PACKED)


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch of packed rows; how many there are tells their width."""
    data = text_buffers(batch.column("ids"))[0]
    many = int(pc.sum(batch.column("n_tokens")).as_py() or 0)
    return data.view("<u2" if len(data) == 2 * many else "<u4")


def id_counts(rows: DataFrame) -> DataFrame:
    """id and how often it occurs in packed rows; a task gives a row for each of its distinct ids."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(unpacked(batch), minlength=len(total))
            own[: len(total)] += total
            total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return rows.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(df: DataFrame, path: str, tokenizer: str, end: int = 1, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text with the tokenizer file and write the folder ``path``."""
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    scratch = folder(spark)
    packed(df, spec, end, id_col, text_col).write.option("compression", "zstd").parquet(scratch)
    rows = spark.read.schema(PACKED).parquet(scratch)
    counts = id_counts(rows).orderBy("id").toPandas()  # a row an id of the vocabulary at most
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    lengths = code_lengths(n, max(longest, int(max(len(ids) - 1, 1)).bit_length()))
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast((ids, lengths))

    def shards(batches):
        codes = Codebook(*book.value)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            own = unpacked(batch)
            n_tokens = batch.column("n_tokens").to_numpy()
            blocks, bits_at, bits = codes.write(own, np.append(0, np.cumsum(n_tokens)))
            lists = [batch.column("doc_id").to_pylist(), n_tokens, blocks, bits_at]
            out = [pa.array([part], pa.int32()), pa.array([shard]), pa.array([before]), pa.array([len(own)]), *(pa.array([v], pa.list_(pa.int64())) for v in lists), pa.array([bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["part", "shard", "before", "n_ids", "doc_ids", "n_tokens", "blocks", "bits_at", "bits"])
            shard, before = shard + 1, before + len(own)

    dealt = rows.withColumn("number", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("number")]
    dealt = dealt.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "n_tokens", "ids").mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")
    remove(spark, scratch)
    totals = spark.read.schema(SHARDS).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", earlier.alias("start")).coalesce(1).write.parquet(f"{path}/parts")  # a row a range


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian numbers of 32 bits) of every document; ``with_ids`` adds the ids."""
    codes = spark.read.schema("id long, length long").parquet(f"{path}/codes").orderBy("id").toPandas()
    book = spark.sparkContext.broadcast((codes["id"].to_numpy(np.int64), codes["length"].to_numpy(np.int64)))
    starts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decode(batches):
        own = Codebook(*book.value)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                n_tokens, blocks, bits_at = (batch.column(c)[row].values.to_numpy() for c in ("n_tokens", "blocks", "bits_at"))
                ids = own.read(batch.column("bits")[row].as_py(), bits_at, block_sizes(n_tokens, blocks)).astype("<u4", copy=False)
                bounds = np.append(0, np.cumsum(n_tokens))
                raw = memoryview(ids).cast("B")
                edges = (bounds * 4).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                out = [doc_ids, pa.array(bounds[:-1] + batch.column("start")[row].as_py()), pa.array(n_tokens), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").join(F.broadcast(starts), "part")
    columns = shards.select("doc_ids", "n_tokens", "blocks", "bits_at", "bits", (F.col("before") + F.col("start")).alias("start"))
    return columns.mapInArrow(decode, schema)


def round_trip(df: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write a new folder among the shared ones and read it back."""
    path = folder(df.sparkSession)
    write(df, path, tokenizer, end)
    return read_ids(df.sparkSession, path)
