"""Records of one large file read by many tasks, where a record may hold the
separator that Spark splits text files at: JSON arrays, CSV with quoted line
breaks.

Spark's text source cuts a file into byte ranges and hands out pieces between
separators (``}`` for JSON, line feeds for CSV), each with its file and range.
What a piece means depends on what precedes it, so the file is read twice:

1. every range is summed up for both states that it may start in (inside or
   outside quotes): the state and depth it ends with, and the least depth on the
   way. One small row per range goes to the driver, which folds them in order;
2. every range, now with its own starting state, gives its whole records. A
   record that crosses ranges comes as parts (read once more, of which only the
   parts remain), put together by the range that it began in.

A task holds one batch of pieces and one record, whatever the file's size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_ESCAPED = re.compile(r"\\.", re.S)
_BLANK = " \t\r\n﻿"

#: (inside quotes, depth) before a piece.
State = tuple[bool, int]


def at_end(state: State) -> bool:
    """Is a record complete, if a piece has just ended in this state?"""
    return not state[0] and state[1] <= 1


class Lines:
    """CSV: a record ends with a line that ends outside quotes (a quote inside a
    field is doubled, so counting quotes tells)."""

    separator = "\n"

    @staticmethod
    def step(state: State, piece: str) -> State:
        return state[0] ^ bool(piece.count('"') & 1), 0

    @staticmethod
    def record(text: str) -> str | None:
        text = text[:-1] if text.endswith("\r") else text
        return text if text.strip() else None

    @staticmethod
    def check(state: State, file: str) -> None:
        if state[0]:
            raise ValueError(f"{file}: a quoted field is not closed")


class Elements:
    """JSON array: an element ends with a brace outside strings after which only
    the array is open (depth 1)."""

    separator = "}"

    @staticmethod
    def step(state: State, piece: str) -> State:
        quoted, depth = state
        if "\\" in piece:
            piece = _ESCAPED.sub("", piece)
        parts = piece.split('"')
        for part in parts[1 if quoted else 0 :: 2]:  # what is outside strings
            depth += part.count("{") + part.count("[") - part.count("]")
        quoted ^= len(parts) % 2 == 0
        return quoted, depth if quoted else depth - 1

    @staticmethod
    def record(text: str) -> str | None:
        at = text.find("{")
        before = text if at < 0 else text[:at]
        rest = before.strip("[," + _BLANK) if at >= 0 else before.strip("[]," + _BLANK)
        if rest:
            raise ValueError(f"an array of records holds {rest[:40]!r}")
        return None if at < 0 else text[at:] + "}"

    @staticmethod
    def check(state: State, file: str) -> None:
        if state != (False, -1):  # the end of the file counts as one more brace
            raise ValueError(f"{file}: not one whole array of records")


Kind = type[Lines] | type[Elements]


def _pieces(spark: SparkSession, path, kind: Kind) -> DataFrame:
    rows = spark.read.option("lineSep", kind.separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, range), pieces in order); a range may come in several lots."""
    for b in batches:
        values, keys = b.column(0).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], values[first:i]
                first = i


_SUM = "file string, at long, quoted0 boolean, depth0 long, low0 long, quoted1 boolean, depth1 long, low1 long"


def _sum_up(kind: Kind) -> Callable:
    """Per range, for a start outside and inside quotes at depth 0: the state at
    the end and the least depth where a piece ended outside quotes."""

    def row(key, states, lows):
        flat = [v for s, low in zip(states, lows) for v in (*s, low)]
        types = [pa.string(), pa.int64()] + [pa.bool_(), pa.int64(), pa.int64()] * 2
        names = [f.split()[0] for f in _SUM.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, *flat), types)], names=names)

    def run(batches):
        held, states, lows = None, [], []
        for key, pieces in _ranges(batches):
            if key != held:
                if held is not None:
                    yield row(held, states, lows)
                held, states, lows = key, [(False, 0), (True, 0)], [None, None]
            for k in (0, 1):
                state, low = states[k], lows[k]
                for piece in pieces:
                    state = kind.step(state, piece)
                    if not state[0] and (low is None or state[1] < low):
                        low = state[1]
                states[k], lows[k] = state, low
        if held is not None:
            yield row(held, states, lows)

    return run


def _places(sums: list, kind: Kind) -> dict[tuple[str, int], tuple[State, int | None]]:
    """Per range: its starting state, and the range in which the record that is
    open there began (None: a record begins with the range)."""
    out, file, state, origin = {}, None, (False, 0), None
    for r in sorted(sums, key=lambda r: (r["file"], r["at"])):
        if r["file"] != file:
            if file is not None:
                kind.check(state, file)
            file, state, origin = r["file"], (False, 0), None
        out[file, r["at"]] = (state, origin)
        k = int(state[0])
        low, depth = r[f"low{k}"], state[1]
        ended = low is not None and depth + low <= 1
        state = (r[f"quoted{k}"], depth + r[f"depth{k}"])
        if at_end(state):
            origin = None
        elif ended or origin is None:
            origin = r["at"]
    if file is not None:
        kind.check(state, file)
    return out


def _records(kind: Kind, places, parts: bool) -> Callable:
    """Whole records, or with ``parts`` the parts of records that cross ranges:
    (file, origin, at, text, first)."""

    def run(batches):
        known = places.value
        held, state, origin, first = None, (False, 0), None, True
        text: list[str] = []
        out: list[tuple] = []

        def close(whole: bool):
            nonlocal first
            joined = kind.separator.join(text)
            text.clear()
            if whole and not parts:
                joined = kind.record(joined)
                if joined is not None:
                    out.append((held[0], held[1], held[1], joined, first))
            elif not whole and parts:
                out.append((held[0], held[1] if origin is None else origin, held[1], joined, first))
            first = False

        for key, pieces in _ranges(batches):
            if key != held:
                if text:
                    close(False)
                held, first = key, key[1] == 0
                state, origin = known[key]
            for piece in pieces:
                state = kind.step(state, piece)
                text.append(piece)
                if at_end(state):
                    close(origin is None)
                    origin = None
            if len(out) >= 512:
                yield batch(out)
                out.clear()
        if text:
            close(False)
        if out:
            yield batch(out)

    def batch(rows):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "origin", "at", "text", "first"]
        )

    return run


def split_records(spark: SparkSession, path, kind: Kind) -> DataFrame:
    """(file, first, text): every record of the files under ``path`` as text;
    ``first`` marks the first record of a file. A file that ends inside a record
    raises. The order of records is not kept."""
    ship_package(spark)
    pieces = _pieces(spark, path, kind)
    found = _places(pieces.mapInArrow(_sum_up(kind), _SUM).collect(), kind)
    places = spark.sparkContext.broadcast(found)
    schema = "file string, origin long, at long, text string, first boolean"
    whole = pieces.mapInArrow(_records(kind, places, False), schema).select("file", "first", "text")
    if all(origin is None for _, origin in found.values()):
        return whole
    parts = pieces.mapInArrow(_records(kind, places, True), schema)
    joined = parts.groupBy("file", "origin").agg(
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p"), F.bool_or("first").alias("first")
    )
    text = F.array_join(F.transform("p", lambda x: x["text"]), kind.separator)
    text = F.concat(text, F.lit("}")) if kind is Elements else F.rtrim(text, F.lit("\r"))
    clean = F.regexp_replace(text, r"^[\[,\s\x{FEFF}]*(?=\{)", "") if kind is Elements else text
    return whole.unionByName(joined.select("file", "first", clean.alias("text")))
