"""Document fingerprints by context-triggered piecewise hashing (Kornblum, 2006).

A hash of the last ``WINDOW`` bytes rolls over a text; where its low k bits are
all set, a chunk ends. k follows from the text's length (about 32 to 64 chunks
at block size 2^k) and falls while there are too few chunks. A chunk becomes a
12-bit code of its own hash; the fingerprint is the block size with the code
sequences at that size and at twice that size. An edit changes the codes of the
chunks it touches only, since a boundary depends on nothing but its window. Two
fingerprints are compared by edit distance (insertions and deletions of codes)
where they share a block size; unrelated sizes have likeness 0.

The rolling hash is evaluated for all positions at once with numpy, slice by
slice; chunks are hashed from their bytes.

For comparing each document with the next one by id, rows go through one shuffle
into ranges of the order (id, text digest). Range bounds are keys of rows: such a
row is sent to its own range and, as what follows, to the range above, so no
window over the whole table and no second pass over texts is needed. Equal rows
are counted by the map task that meets them, so a text repeated a million times
moves once per task."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from .common import python_tasks

WINDOW = 7
#: Most chunks of a fingerprint, and fewest before the block size is halved.
CHUNKS, LEAST = 64, 32
#: Smallest block size, as a power of two.
LOWEST = 2
CODE_BITS = 12
SLICE = 1 << 20
#: Bytes of text that one range task is planned for.
RANGE_BYTES = 16 << 20
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = 0x9E3779B1


def _levels(data: bytes) -> np.ndarray:
    """Per byte, how many low bits of the rolling hash are set: a position is a
    boundary at every block size 2^k with k up to that."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(len(raw), np.uint8)
    for s in range(0, len(raw), SLICE):
        from_ = max(0, s - WINDOW + 1)
        x = raw[from_ : s + SLICE].astype(np.uint32) + np.uint32(1)
        h = np.zeros(len(x), np.uint32)
        power = 1
        for back in range(min(WINDOW, len(x))):
            h[back:] += x[: len(x) - back] * np.uint32(power)
            power = power * _FACTOR & 0xFFFFFFFF
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        out[s : s + SLICE] = (np.bitwise_count(h ^ (h + np.uint32(1))) - 1)[s - from_ :]
    return out


def _codes(data: bytes, ends: np.ndarray) -> str:
    cuts = ends[: CHUNKS - 1].tolist()
    if not cuts or cuts[-1] != len(data):
        cuts.append(len(data))
    out, start = [], 0
    for end in cuts:
        code = xxhash.xxh3_64_intdigest(data[start:end]) >> 64 - CODE_BITS
        out.append(DIGITS[code >> 6] + DIGITS[code & 63])
        start = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """``block size:codes:codes at twice the size`` of a text's UTF-8 bytes, two
    digits a code. Empty: the lowest block size without codes. Equal texts have
    equal fingerprints."""
    k = LOWEST
    if not data:
        return f"{1 << k}::"
    while CHUNKS << k < len(data):
        k += 1
    levels = _levels(data)
    spots = np.flatnonzero(levels >= LOWEST)
    at = levels[spots]
    while k > LOWEST and np.count_nonzero(at >= k) < LEAST:
        k -= 1
    return f"{1 << k}:{_codes(data, spots[at >= k] + 1)}:{_codes(data, spots[at > k] + 1)}"


def _sequence(codes: str) -> list[str]:
    """Codes, runs of more than three equal ones cut to three: they say little."""
    out: list[str] = []
    for i in range(0, len(codes), 2):
        c = codes[i : i + 2]
        if out[-3:] != [c] * 3:
            out.append(c)
    return out


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions and deletions that turn a into b: both lengths less twice the
    longest common subsequence, whose bits are carried in one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where no block size is shared."""
    if a == b:
        return 1.0
    (size_a, *codes_a), (size_b, *codes_b) = a.split(":"), b.split(":")
    sizes_a = {int(size_a): codes_a[0], 2 * int(size_a): codes_a[1]}
    sizes_b = {int(size_b): codes_b[0], 2 * int(size_b): codes_b[1]}
    best = 0.0
    for size in sizes_a.keys() & sizes_b.keys():
        x, y = _sequence(sizes_a[size]), _sequence(sizes_b[size])
        if x and y:
            best = max(best, 1.0 - edit_distance(x, y) / (len(x) + len(y)))
    return best


def add_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All rows and columns of ``docs`` (as ``doc``) with the fingerprint of each
    whole text (null: empty) as ``out_col``. One map pass. Empty: empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wrapped = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = StructType([wrapped.schema["doc"], StructField(out_col, StringType())])
    shape = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t.encode()) for t in b.column("body").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc").cast(shape.field(0).type), found], schema=shape)

    return python_tasks(wrapped, run, kind)


def _place(id_, digest: str) -> tuple:
    """A row's place in rising order: null ids lowest, equal ids by digest."""
    return (id_ is not None, 0 if id_ is None else id_, digest)


def _ranges(rows: DataFrame, range_bytes: int) -> tuple[int, list[tuple], tuple | None]:
    """(tasks, bounds, highest place). Bounds are places of rows, taken from a
    hash sample of the distinct places; they decide who works where, no result."""
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "digest")
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("bytes"), F.max(place).alias("top")
    ).first()
    if not size["n"]:
        return 1, [], None
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(least, -(-size["bytes"] // range_bytes)), 25_000)
    wanted = 16 * tasks
    picked = rows.select("id", "digest")
    if size["n"] > wanted:
        share = int((1 << 30) * wanted / size["n"]) + 1
        picked = picked.where(F.pmod(F.xxhash64("digest", "id"), F.lit(1 << 30)) < share)
    places = sorted(_place(r[0], r[1]) for r in picked.distinct().collect())
    step = max(1, len(places) // (4 * tasks))
    return tasks, places[step - 1 : -1 : step], _place(size["top"]["id"], size["top"]["digest"])


def _dealer(bounds: list[tuple], top: tuple, schema: pa.Schema):
    """Rows to their range; the row of a bound also, as what follows, to the
    range above it and the highest row to the lowest range. Repeated rows of a
    task: the text once, then a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple, int] = {}
        for b in batches:
            out = []
            for id_, digest, body in zip(*(b.column(c).to_pylist() for c in ("id", "digest", "body"))):
                place = _place(id_, digest)
                at = bisect_left(bounds, place)
                if place in again:
                    again[place] += 1
                    continue
                again[place] = 0
                out.append((at, False, id_, digest, body, 1))
                if at < len(bounds) and bounds[at] == place:
                    out.append((at + 1, True, id_, digest, body, 0))
                if place == top:
                    out.append((0, True, id_, digest, body, 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        rest = [(bisect_left(bounds, p), False, p[1] if p[0] else None, p[2], None, n) for p, n in again.items() if n]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), schema)], schema=schema)

    return run


def _edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all)
    of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Text:
    def __init__(self, range_, id_, digest, body):
        self.key, self.id, self.body, self.copies = (range_, id_, digest), id_, body, 0
        self._print = None

    @property
    def print_(self) -> str:
        if self._print is None:
            self._print = fingerprint(self.body.encode())
        return self._print

    def report(self, following: _Text, copies: int) -> tuple:
        edited = _edited(self.body, following.body).encode()
        found = fingerprint(edited)
        return (
            self.id, len(self.body), hashlib.sha256(edited).hexdigest(), self.print_, found,
            likeness(self.print_, found), likeness(self.print_, following.print_), copies,
        )


def _reporter(schema: pa.Schema):
    """Walks its ranges in falling order, holding one text and its follower."""

    def rows_of(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "id", "digest", "body", "copies")))

    def reports(batches):
        last: _Text | None = None
        for range_, ahead, id_, digest, body, copies in rows_of(batches):
            key = (range_, id_, digest)
            if not ahead and last is not None and last.key == key:
                last.copies += copies
                continue
            if ahead and (last is None or last.key[0] != range_):
                continue  # a bound sent ahead by another task, or a range without rows
            here = _Text(range_, id_, digest, body)
            if last is not None:
                yield last.report(here, 1)
                if last.copies > 1:
                    yield last.report(last, last.copies - 1)
            here.copies = copies
            last = None if ahead else here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in reports(batches):
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def edit_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per document: ``id_col``, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document by falling id (after the last: the
    first). Null texts are empty. Null ids come last; documents that share an id
    are ordered by a digest of their text, equal rows follow each other. A lone
    document follows itself. Other columns are ignored. Empty: empty. A task holds
    two texts and one digest per document of its input partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).withColumn("digest", F.md5(F.col("body").cast("binary")))
    tasks, bounds, top = _ranges(rows, range_bytes)
    id_kind = docs.schema[id_col].dataType
    dealt_kind = StructType.fromDDL("range int, ahead boolean, id int, digest string, body string, copies long")
    dealt_kind["id"].dataType = id_kind
    dealt = python_tasks(rows, _dealer(bounds, top, to_arrow_schema(dealt_kind)), dealt_kind)
    walked = dealt.repartition(tasks, "range").sortWithinPartitions(
        "range", "ahead", F.desc_nulls_last("id"), F.desc("digest"), F.col("body").isNull()
    )
    kind = StructType.fromDDL(
        "id int, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, copies long"
    )
    kind["id"].dataType = id_kind
    found = python_tasks(walked, _reporter(to_arrow_schema(kind)), kind)
    repeated = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.drop("copies", "copy").withColumnRenamed("id", id_col)
