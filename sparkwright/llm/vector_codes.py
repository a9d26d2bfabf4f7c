"""Vector code compression by active-entry Lloyd rounds (product codes).

Vectors become integers (floor of ``SCALE`` times each component) and are cut
into equal consecutive parts; every part position has a codebook. A round
assigns each part to its nearest entry and then moves each entry to the floored
mean of its parts. A row carries the entry and the exact distance of each part
from round to round: where that entry did not move, every other entry that
stayed is still no better, so the part is compared with the moved entries only;
where it moved, the part rescans the whole codebook. Ties go to the lower index
in both cases.

On Spark: a round is one map over the checkpointed rows of the round before it.
A task sums its own parts per entry, Spark adds these sums up, and only the
codebooks (entries x components, whatever the number of rows) reach the driver.
All arithmetic is exact: matrix products in double precision where every partial
sum is an integer below 2^53, Python integers beyond; sums travel in limbs of
``LIMB`` bits, so no sum can pass a long."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from .common import cut, python_tasks

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMB = 40
#: Distances of these many parts x entries are held at once.
BLOCK_ROWS = 4096
#: Stored in place of a distance beyond 64 bits; such a part always rescans.
UNKNOWN = -1


def usable(vector: Column) -> Column:
    """Not null, and every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of equal length; where ``dim`` does not divide, the
    first ones are longer by one."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where all are small, Python integers otherwise."""
    scaled = np.floor(values * float(scale)) if not values.size or np.abs(values).max() < 2.0**40 else None
    if scaled is not None:
        return scaled.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    out = np.empty(values.size, object)
    out[:] = whole
    return out.reshape(values.shape)


def _limit(width: int) -> int:
    """Largest component for which squared distances are exact in doubles."""
    return math.isqrt((1 << 51) // max(width, 1))


def _largest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries)."""
    if max(_largest(x), _largest(book)) <= _limit(x.shape[1]):
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a, b = x.astype(object), book.astype(object)
    out = np.empty((len(a), len(b)), object)
    for i, row in enumerate(a):
        out[i] = [sum(d * d for d in row - entry) for entry in b]
    return out


def _closest(x: np.ndarray, book: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the entries ``index`` (ascending): (entry, distance)."""
    d = distances(x, book[index])
    at = np.array([int(min(range(len(r)), key=r.__getitem__)) for r in d]) if d.dtype == object else d.argmin(1)
    return index[at], d[np.arange(len(d)), at]


def assign(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, dist: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and exact distance of each part. ``moved`` marks entries
    that the last round changed; ``entry`` and ``dist`` are what the part had
    before (entry -1: none yet)."""
    new_entry, new_dist = entry.copy(), dist.astype(object) if x.dtype == object else dist.copy()
    stays = (entry >= 0) & (dist != UNKNOWN)
    stays[stays] = ~moved[entry[stays]]
    scan = np.flatnonzero(~stays)
    if len(scan):
        found, far = _closest(x[scan], book, np.arange(len(book)))
        new_dist = new_dist.astype(object) if far.dtype == object else new_dist
        new_entry[scan], new_dist[scan] = found, far
    active = np.flatnonzero(moved)
    keep = np.flatnonzero(stays)
    if len(active) and len(keep):
        found, far = _closest(x[keep], book, active)
        old, old_entry = dist[keep], entry[keep]
        better = (far < old) | ((far == old) & (found < old_entry))
        better = better.astype(bool)
        new_dist = new_dist.astype(object) if far.dtype == object else new_dist
        new_entry[keep[better]], new_dist[keep[better]] = found[better], far[better]
    return new_entry, new_dist


def _row_blocks(values: np.ndarray) -> Iterator[np.ndarray]:
    """Row indexes, small rows apart from those with huge components."""
    huge = np.abs(values).max(1, initial=0.0) >= 2.0**20
    for rows in (np.flatnonzero(~huge), np.flatnonzero(huge)):
        for i in range(0, len(rows), BLOCK_ROWS):
            yield rows[i : i + BLOCK_ROWS]


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


def _assigner(dim: int, parts: int, scale: int, books: list[np.ndarray], moved: list[np.ndarray], schema: pa.Schema):
    bounds = part_bounds(dim, parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column("vector"), np.float64, dim)
            entry = _matrix(batch.column("entry"), np.int64, parts)
            dist = _matrix(batch.column("dist"), np.int64, parts)
            for rows in _row_blocks(values):
                x = integers(values[rows], scale)
                for p, (a, b) in enumerate(bounds):
                    e, d = assign(x[:, a:b], books[p], moved[p], entry[rows, p], dist[rows, p])
                    if d.dtype == object:
                        d = np.array([v if v < 1 << 63 else UNKNOWN for v in d], np.int64)
                    entry[rows, p], dist[rows, p] = e, d
            ends = pa.array(np.arange(0, entry.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), batch.column("vector"),
                pa.ListArray.from_arrays(ends, pa.array(entry.ravel().astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(dist.ravel())),
            ], schema=schema)

    return task


def _summer(dim: int, parts: int, scale: int, entries: int):
    """Partial sums of a task: (part, entry, pos, limb, value); pos -1 counts."""
    bounds = part_bounds(dim, parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = [np.zeros((entries, b - a), np.int64) for a, b in bounds]
        large = [{} for _ in bounds]
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column("vector"), np.float64, dim)
            entry = _matrix(batch.column("entry"), np.int64, parts)
            for rows in _row_blocks(values):
                x = integers(values[rows], scale)
                for p, (a, b) in enumerate(bounds):
                    counts[p] += np.bincount(entry[rows, p], minlength=entries)
                    if x.dtype != object and _largest(x) < 1 << 31:
                        np.add.at(small[p], entry[rows, p], x[:, a:b])
                    else:
                        for e, row in zip(entry[rows, p].tolist(), x[:, a:b].tolist()):
                            for pos, v in enumerate(row):
                                large[p][e, pos] = large[p].get((e, pos), 0) + int(v)
        out = []
        for p in range(parts):
            for e in np.flatnonzero(counts[p]).tolist():
                out.append((p, e, -1, 0, int(counts[p, e])))
                for pos, v in enumerate(small[p][e].tolist()):
                    v += large[p].get((e, pos), 0)
                    rest, limb = abs(v), 0
                    while rest:
                        part = rest & (1 << LIMB) - 1
                        if part:
                            out.append((p, e, pos, limb, part if v > 0 else -part))
                        rest, limb = rest >> LIMB, limb + 1
        names = ["part", "entry", "pos", "limb", "value"]
        columns = list(zip(*out)) if out else [()] * 5
        types = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return task


def _book_array(rows: list[list[int]], width: int) -> np.ndarray:
    """Entries as int64, or Python integers where one does not fit."""
    small = all(abs(v) < 1 << 62 for r in rows for v in r)
    out = np.zeros((len(rows), width), np.int64 if small else object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def _moved_books(state: DataFrame, books: list[np.ndarray], dim: int, parts: int, scale: int):
    """Entries after a round, and which of them differ from before."""
    entries = len(books[0])
    sums: dict[tuple[int, int, int], int] = {}
    partial = python_tasks(state.select("vector", "entry"), _summer(dim, parts, scale, entries),
                           "part int, entry int, pos int, limb int, value long")
    for part, entry, pos, limb, value in partial.groupBy("part", "entry", "pos", "limb").agg(F.sum("value")).collect():
        sums[part, entry, pos] = sums.get((part, entry, pos), 0) + (value << LIMB * limb)
    new, moved = [], []
    for p, book in enumerate(books):
        rows = [list(map(int, r)) for r in book]
        for e in range(entries):
            n = sums.get((p, e, -1), 0)
            if n:
                rows[e] = [sums.get((p, e, pos), 0) // n for pos in range(book.shape[1])]
        new.append(_book_array(rows, book.shape[1]))
        moved.append(np.array([a != list(map(int, b)) for a, b in zip(rows, book)], bool))
    return new, moved


def quantize(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable vectors, and the codebooks (one array per part).

    Rows (id, label, entry array<int>, error long): error is the sum of the
    parts' final squared distances, null where it passes 64 bits. Rows whose
    vector is null or holds null or non-finite components are dropped. The
    codebooks start as the ``entries`` smallest ids (nulls last; repeated ids by
    vector); with fewer rows there are fewer entries. Vectors have the most
    frequent length of the table (ties: the shorter); a usable vector of another
    length stays, with null entry and error, and counts in no entry. Repeated
    rows each count. Other columns are ignored. Empty: empty, no codebook."""
    if entries > 256:
        raise ValueError("at most 256 entries per part")
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType != ArrayType(FloatType()):
        v = v.cast("array<double>")
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector")
    ).where(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return rows.select("id", "label", F.lit(None).cast("array<int>").alias("entry"), F.lit(0).cast("long").alias("error")), []
    dim = common["d"]
    mine = rows.where(F.size("vector") == dim)
    first = mine.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = integers(np.array([r[0] for r in first], np.float64).reshape(len(first), dim), scale)
    bounds = part_bounds(dim, parts)
    books = [_book_array([list(map(int, r)) for r in start[:, a:b]], b - a) for a, b in bounds]
    moved = [np.ones(len(first), bool) for _ in bounds]

    schema = StructType([
        *mine.schema.fields,
        StructField("entry", ArrayType(IntegerType())),
        StructField("dist", ArrayType(LongType())),
    ])
    arrow = _arrow_schema(schema)
    none = F.array_repeat(F.lit(-1), parts)
    state = mine.select("*", none.alias("entry"), none.cast("array<long>").alias("dist"))
    for _ in range(rounds):
        state = cut(python_tasks(state, _assigner(dim, parts, scale, books, moved, arrow), schema))
        books, moved = _moved_books(state, books, dim, parts, scale)
    state = python_tasks(state, _assigner(dim, parts, scale, books, moved, arrow), schema)
    total = F.aggregate("dist", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)"))
    error = F.when(~F.array_contains("dist", UNKNOWN), total).try_cast("long")
    other = rows.where(F.size("vector") != dim).select(
        "id", "label", F.lit(None).cast("array<int>").alias("entry"), F.lit(None).cast("long").alias("error")
    )
    return state.select("id", "label", "entry", error.alias("error")).unionByName(other), books


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries: decimal components by part, entry and position."""
    digest, first = hashlib.sha256(), True
    for book in books:
        for row in book:
            for x in row:
                digest.update(f"{'' if first else ','}{int(x)}".encode())
                first = False
    return digest.hexdigest()


def code_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): the digest of
    :func:`quantize`. code is two hex digits per part; label_error sums the
    errors of a label (null labels together; null where the sum passes 64 bits)."""
    coded, books = quantize(vectors, id_col, vector_col, label_col)
    digits = F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))
    coded = cut(coded.select("id", "label", F.array_join(digits, "").alias("code"), "error"))
    per_label = coded.groupBy(F.col("label").alias("sum_label")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    )
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("sum_label")))
    return joined.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
