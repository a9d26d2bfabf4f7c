"""Best-fit packing of token sequences by the sum-of-squares rule.

Each piece goes to the open bin for which the sum over all gaps of the squared
number of open bins with that gap becomes smallest (Csirik et al., 2006); of
equal ones to the fullest. Pieces come in falling length and a bin is opened
only when none has room, so that few bins stay open at the end.

On Spark: one pass cuts every text into pieces and measures them (ids can ride
along); pieces are dealt by hash to packers of about ``PACKER_PIECES`` pieces
and sorted by length there (Spark's sort spills). A packer reads its pieces as
a stream and holds only the open bins per gap, so its state is bounded by the
capacity and its open bins. More packers cost at most their last open bins."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from .bpe import _BYTE_LEVEL, _byte_alphabet, _file, _younger
from .common import cut, python_tasks

CAPACITY = 2048
#: Pieces per packer: the order of what one task sorts and packs.
PACKER_PIECES = 100_000


class Ids:
    """Ids of a byte-level vocabulary file, as the tokenizers library gives
    them. Files whose ids follow their merge order go through the rank form of
    the same vocabulary, which is several times faster; others, and texts with
    a special token's string, go through the library."""

    def __init__(self, text: str):
        self.text, self._library = text, None
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocab[a + b] for a, b in pairs]
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.unknown, self.fast = regex.compile(_younger()[0]), None
        if plain and spec["normalizer"] is None and made == sorted(made) and len(made) + 256 >= len(vocab) - len(self.special):
            byte = {c: b for b, c in enumerate(_byte_alphabet())}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        same = text.isascii() or max(text) < "\u0530" or not self.unknown.search(text)  # one Unicode version for both
        if self.fast is not None and same and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.library().encode(text, add_special_tokens=False).ids, np.uint32)

    def library(self) -> Tokenizer:
        """The tokenizers instance, made when a text first needs it."""
        if self._library is None:
            self._library = Tokenizer.from_str(self.text)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library


@lru_cache(maxsize=2)
def _load(text: str) -> Ids:
    return Ids(text)


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    id_type: str = "<u4",
) -> DataFrame:
    """(id, piece, start, length, crc[, ids]) of every row: its ids and then
    ``end_id``, cut into pieces of ``capacity`` from the end, so that only the
    first may be shorter. Null texts are empty. ``ids`` is binary, of ``id_type``;
    the crc is that of the ids as little-endian unsigned 32-bit integers."""
    top = np.iinfo(np.dtype(id_type)).max
    shared = _file(docs, path)
    fields = [
        StructField("id", docs.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", IntegerType()), StructField("crc", LongType()), StructField("ids", BinaryType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _load(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                row, out = [], []
                for r, text in enumerate(b.column(1).to_pylist()):
                    ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4")
                    if with_ids and ids.max() > top:
                        raise ValueError(f"id {ids.max()} does not fit {id_type}")
                    lead = len(ids) % capacity or capacity
                    at = [0, *range(lead, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(at, at[1:])):
                        part = ids[s:e]
                        row.append(r)
                        out.append((k, s, e - s, zlib.crc32(part.tobytes()), part.astype(id_type).tobytes() if with_ids else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns], names=[f.name for f in fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = python_tasks(rows, run, StructType(fields))
    return made if with_ids else made.drop("ids")


class Packer:
    """Open bins by gap; ``place`` gives (bin, offset) of the next piece."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.open = np.zeros(capacity + 1, np.int64)  # bins per gap
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        gaps = np.flatnonzero(self.open[length:]) + length
        if len(gaps):
            # The sum changes by 2 (open[gap - length] - open[gap]) + 2, or,
            # when the bin is filled and so closed, by 1 - 2 open[gap].
            left = gaps - length
            change = 2 * (np.where(left > 0, self.open[left], 0) - self.open[gaps]) + np.where(left > 0, 2, 1)
            gap = int(gaps[np.argmin(change)])
            number = self.at[gap].pop()
            self.open[gap] -= 1
        else:
            gap, number = self.capacity, self.bins
            self.bins += 1
        if gap > length:
            self.at[gap - length].append(number)
            self.open[gap - length] += 1
        return number, self.capacity - gap


def keyed_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """:func:`pieces` with a row key, written once: a recomputed task deals every
    row as before."""
    return cut(pieces(docs, path, id_col, text_col, capacity, with_ids=with_ids).withColumn("key", F.monotonically_increasing_id()))


def pack(made: DataFrame, capacity: int = CAPACITY, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`keyed_pieces`: pieces of
    a sequence stand one after the other from offset 0, ``capacity`` at most.
    The number of packers follows a count of the pieces; they are dealt by the
    row key, so equal rows spread too."""
    packers = max(1, -(-made.count() // packer_pieces))
    dealt = made.repartition(packers, "key")
    ordered = dealt.sortWithinPartitions(F.desc("length"), "id", "piece", "crc", "key").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity)
        for b in batches:
            placed = np.array([packer.place(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])], names=[*b.schema.names, "sequence_id", "offset"]
            )

    kind = StructType([*ordered.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return python_tasks(ordered, run, kind)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """One row per piece: (``id_col``, piece, start, length, ids_crc32,
    sequence_id, offset). Every row of ``docs`` has a piece at least (its end
    id), null and empty texts too; null and repeated ids are documents of
    their own; equal lengths are placed in order of id and piece. Other
    columns are ignored, whatever their names. Empty: empty."""
    made = keyed_pieces(docs, path, id_col, text_col, capacity)
    return pack(made, capacity, packer_pieces).select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "sequence_id", "offset",
    )


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """The packed token sequences: (sequence_id, ids array<int>, lengths
    array<int> of its pieces in order), ``capacity`` ids at most."""
    made = keyed_pieces(docs, path, id_col, text_col, capacity, with_ids=True)
    whole = pack(made, capacity, packer_pieces).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts").to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int32) for x in parts]
            lengths = [[p["length"] for p in x] for x in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))],
                names=["sequence_id", "ids", "lengths"],
            )

    kind = StructType([StructField("sequence_id", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("lengths", ArrayType(IntegerType()))])
    return python_tasks(whole, run, kind)
