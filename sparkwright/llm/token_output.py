"""Token-id output: best-fit-decreasing packing into id matrices.

Every text becomes ids, overlong ones are split without loss, and pieces are
placed in falling length into the fullest row that still has room. A segment
tree over the possible gaps (0 .. capacity) finds that row: its leaves count
the open rows per gap, and the search walks to the first gap that is large
enough. Rows come out as padded id vectors with cumulative segment lengths and
the columns where positions restart; :func:`matrices` stacks them to blocks.

On Spark: one pass makes the pieces; they are dealt by a row key to packers of about
``PACKER_PIECES`` pieces, and a packer holds its own pieces only (a few tens of
MB), so rows are complete without a second shuffle of ids. The number of
packers follows the bytes of the texts. More packers cost at most their last
open rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import cut, python_tasks
from .packing import CAPACITY, pieces

#: Pieces per packer, at three bytes a token: what one task holds.
PACKER_PIECES = 8_000
PAD_ID = 0
#: Rows of a matrix.
MATRIX_ROWS = 256


class GapTree:
    """Segment tree over gaps 0 .. capacity, counting open rows per gap."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, gap: int, change: int) -> None:
        at = gap + self.leaves
        while at:
            self.count[at] += change
            at >>= 1

    def first(self, gap: int) -> int | None:
        """Smallest gap of an open row that is ``gap`` or larger."""
        count, at = self.count, gap + self.leaves
        while not count[at]:  # up, until a right neighbour has rows
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:  # down, to its leftmost leaf with rows
            at *= 2
            if not count[at]:
                at += 1
        return at - self.leaves


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, row, offset): pieces in falling length (ties as they come), and
    the row and column each of them gets."""
    order = np.argsort(-lengths, kind="stable")
    row, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    tree, at, rows = GapTree(capacity), [[] for _ in range(capacity + 1)], 0
    for i, n in enumerate(lengths[order].tolist()):
        gap = tree.first(n)
        if gap is None:
            gap, number = capacity, rows
            rows += 1
        else:
            number = at[gap].pop()
            tree.add(gap, -1)
        row[i], offset[i] = number, capacity - gap
        if gap > n:
            at[gap - n].append(number)
            tree.add(gap - n, 1)
    return order, row, offset


def packed_rows(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    pad_id: int = PAD_ID,
    id_type: str = "<u2",
    packer_pieces: int = PACKER_PIECES,
) -> DataFrame:
    """One row per packed sequence: sequence_id, ids (binary: ``capacity`` ids of
    ``id_type``, padded with ``pad_id``), cu_seqlens (0, end of each segment ...),
    position_resets (columns where positions restart at 0), and per segment its
    document id, piece number and first token (doc_ids, pieces, starts).

    Every row of ``docs`` has a segment at least (its end id), null and empty
    texts too; null and repeated ids are documents of their own; equal lengths
    are placed as they come. Other columns are ignored, whatever their names. An
    id that does not fit ``id_type`` raises. Empty: empty."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first()
    packers = max(1, -(-(size["n"] + (size["b"] or 0) // (3 * capacity)) // packer_pieces))
    made = pieces(docs, path, id_col, text_col, capacity, end_id, with_ids=True, id_type=id_type)
    made = cut(made.withColumn("key", F.monotonically_increasing_id()))  # equal rows are dealt apart, retries agree
    dealt = made.repartition(packers, "key").drop("key")
    width = np.dtype(id_type).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        order, row, offset = best_fit_decreasing(t.column("length").to_numpy(), capacity)
        by_row = np.lexsort((offset, row))
        order, row = order[by_row], row[by_row]
        bounds = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        body, lengths = t.column("ids").combine_chunks(), t.column("length").to_numpy()
        own = {c: t.column(c).to_pylist() for c in ("id", "piece", "start")}
        base = TaskContext.get().partitionId() << 40
        pad = np.array([pad_id], id_type).tobytes()
        for first in range(0, len(bounds) - 1, 64):
            out = []
            for s, e in zip(bounds[first : first + 64], bounds[first + 1 : first + 65]):
                picked = order[s:e]
                ends = np.cumsum(lengths[picked])
                ids = b"".join(body[int(i)].as_buffer().to_pybytes() for i in picked)
                out.append((
                    base + int(row[s]), ids + pad * (capacity - len(ids) // width), [0, *ends.tolist()], [0, *ends[:-1].tolist()],
                    *([own[c][i] for i in picked] for c in ("id", "piece", "start")),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*out), kinds)], names=kind.names)

    id_kind = docs.schema[id_col].dataType
    ints = ArrayType(IntegerType())
    kind = StructType([
        StructField("sequence_id", LongType()), StructField("ids", BinaryType()), StructField("cu_seqlens", ints),
        StructField("position_resets", ints), StructField("doc_ids", ArrayType(id_kind)), StructField("pieces", ints),
        StructField("starts", ArrayType(LongType())),
    ])
    i32 = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.binary(), i32, i32, None, i32, pa.list_(pa.int64())]
    return python_tasks(dealt, run, kind)


def matrices(packed: DataFrame, rows: int = MATRIX_ROWS) -> DataFrame:
    """Blocks of up to ``rows`` packed rows: matrix_id, n_rows, ids (the row
    vectors one after the other), segments per row, and all cumulative segment
    lengths as little-endian 32-bit integers, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                cu = b.column("cu_seqlens")
                row = (
                    base + number, b.num_rows, b"".join(b.column("ids").to_pylist()),
                    [len(x) - 1 for x in cu.to_pylist()], cu.flatten().to_numpy().astype("<i4").tobytes(),
                )
                number += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
                names = ["matrix_id", "n_rows", "ids", "segments", "cu_seqlens"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    schema = "matrix_id long, n_rows int, ids binary, segments array<int>, cu_seqlens binary"
    return python_tasks(packed.select("ids", "cu_seqlens"), run, schema)


def write_matrices(packed: DataFrame, path: str, rows: int = MATRIX_ROWS) -> None:
    """The blocks as Parquet files, written by Spark's own committer (a lost
    executor leaves no partial file behind)."""
    matrices(packed, rows).write.parquet(path)


def position_ids(cu_seqlens: np.ndarray, capacity: int) -> np.ndarray:
    """Positions of one packed row: they restart at every segment; padding is
    a segment of its own."""
    cu = np.asarray(cu_seqlens)
    if cu[-1] < capacity:
        cu = np.append(cu, capacity)
    return np.arange(capacity) - np.repeat(cu[:-1], np.diff(cu))
