"""Substring dedup by minimizer k-mers, a filter in place of the compaction of a
De Bruijn graph: no degree of a node is computed, no edge joined to the next.

Token k-mers are the edges (from their first to their last k-1 words). Every
window of ``WINDOW`` words keeps its minimizer, the k-mer of the
smallest hash, so two equal windows keep the same edge and about one edge in
14 words has to move. Three Spark joins follow:

1. edges seen at least twice in the corpus are joined back to their documents;
2. the windows that keep a repeated edge, here called paths, are picked. Only
   these windows can repeat;
3. the windows of the paths meet by a 96-bit hash of all their words with
   their source coordinates (document, word number); those found at a second
   coordinate are verified, and their words are removed.

Before rows move, each batch settles what it sees twice itself and sends one
row per distinct value with its weight, so a passage in a third of all
documents costs one row per batch and no task gets all of its occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import python_tasks, utf8

WINDOW = 35
K = 8
#: Bytes of text handled at once (a longer text is handled alone).
BATCH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the next batch."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        step = np.full(n + n // 8 + 1024, base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[: n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[:-1], out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values))
    return _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a batch of texts as positions and 64-bit hashes."""

    def __init__(self, texts: list[bytes | None]):
        joined = b"\n".join(t or b"" for t in texts)
        raw = np.frombuffer(joined, np.uint8)
        edge = np.diff(_SPACE[raw].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begin)  # of each text, and the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = _spans(raw.astype(np.uint64) + np.uint64(1), self.start, self.end, _ODD[0])

    def grams(self, n: int, base: int) -> np.ndarray:
        """Hash of the n words from each word on (shorter by n - 1)."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        return _spans(self.hash, at, at + n, base)

    def windows(self, n: int) -> np.ndarray:
        """Starts of the windows of n words that lie within one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])

    def minimizers(self, k: int, window: int) -> np.ndarray:
        """Position of the smallest k-mer (leftmost) of the window at each word."""
        value = self.grams(k, _ODD[1])
        place = np.arange(len(value))
        width, reach = 1, window - k + 1
        while width < reach:
            step = min(width, reach - width)
            later = value[step:] < value[: len(value) - step]
            place = np.where(later, place[step:], place[: len(place) - step])
            value = np.where(later, value[step:], value[: len(value) - step])
            width += step
        return place


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_BYTES`` of text; a longer text comes alone."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            limit = (size[at - 1] if at else 0) + BATCH_BYTES
            end = max(at + 1, int(np.searchsorted(size, limit, side="right")))
            yield b.slice(at, end - at)
            at = end


#: run: a << 32 | b for the places a..b of one value, its complement if they
#: are settled, _SEEN for a value that its batch has seen twice.
_MOVED = "h long, c int, i long, x int, run long"
_SEEN = -(1 << 63)


def _settle(b: pa.RecordBatch, h: np.ndarray, c: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows to move for the values (h, c) at (doc, place) of one batch, places
    ascending: a value seen twice here moves as one row without a place and
    its places are settled, as runs; one seen once wants an answer."""
    order = np.lexsort((c, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = order[new]
    count = np.diff(np.append(np.flatnonzero(new), len(h)))
    known = np.zeros(len(h), bool)
    known[order] = np.repeat(count > 1, count)
    d, p = doc[known], place[known]
    breaks = np.ones(len(d), bool)
    breaks[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.flatnonzero(breaks)
    end = np.append(start[1:], len(d))[: len(start)] - 1
    runs, many = len(start), count > 1
    of = np.concatenate([np.where(many, 0, doc[first]), d[start]])
    spread = _mix((d[start].astype(np.uint64) << np.uint64(32)) + p[start].astype(np.uint64))
    single = np.where(many, _SEEN, place[first] << 32 | place[first])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[first], spread]).view(np.int64)),
            pa.array(np.concatenate([c[first], np.zeros(runs, np.uint64)]).astype(np.uint32).view(np.int32)),
            b.column("i").take(pa.array(of)),
            b.column("x").take(pa.array(of)),
            pa.array(np.concatenate([single, ~(p[start] << 32 | p[end])])),
        ],
        names=["h", "c", "i", "x", "run"],
    )


def _meet(rows: DataFrame, name: str) -> DataFrame:
    """Distinct runs (a << 32 | b) per document of the values found at two
    coordinates; copies that share (i, x) share them, so their number does not
    lengthen the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the value that a batch ends with, only its weight and the one row
        # that still waits for a second are kept, however often it occurs
        last, weight, waiting = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            h, c, places = (b.column(k).to_numpy() for k in ("h", "c", "run"))
            w = np.where(places >= 0, 1, np.where(places == _SEEN, 2, 0))
            goes_on = (h[0], c[0]) == last
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            start = np.flatnonzero(new)
            total = np.add.reduceat(w, start)
            if goes_on:
                total[0] += weight
                if waiting is not None and total[0] > 1:
                    yield waiting
            if not goes_on or total[0] > 1 or len(start) > 1:
                waiting = None
            found = (w == 0) | ((w == 1) & (np.repeat(total, np.diff(np.append(start, len(h)))) > 1))
            rows_ = pa.table({"i": b.column("i"), "x": b.column("x"), "run": pa.array(np.where(w == 0, ~places, places))})
            yield from rows_.filter(pa.array(found)).combine_chunks().to_batches()
            last, weight = (h[-1], c[-1]), min(int(total[-1]), 2)
            own = start[-1] + np.flatnonzero(w[start[-1] :] == 1)
            if weight == 1 and len(own):
                waiting = rows_.slice(int(own[0]), 1).combine_chunks().to_batches()[0]

    met = python_tasks(rows.repartition("h", "c").sortWithinPartitions("h", "c"), run, "i long, x int, run long")
    return met.groupBy("i", "x").agg(F.collect_set("run").alias(name))


def _mask(words: Words, b: pa.RecordBatch, name: str, reach: int = 1) -> np.ndarray:
    """Words of the batch in the runs of column ``name``, each run prolonged
    by ``reach`` - 1 words."""
    runs = b.column(name)
    count = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    flat = runs.flatten().to_numpy()
    base = np.repeat(words.first[:-1], count)
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, base + (flat >> 32), 1)
    np.add.at(change, base + (flat & 0xFFFFFFFF) + reach, -1)
    return np.cumsum(change)[:-1] > 0


def _cut_text(text: bytes, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """``text`` without the words not kept; each kept run keeps its inner
    white space and, after another, the white space before it."""
    runs = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    out = []
    for s, e in zip(runs[::2], runs[1::2]):
        out.append(text[(end[s - 1] if out else start[s]) : end[e - 1]])
    return b"".join(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (struct of all its columns but the
    text, so their names cannot clash), ``text`` (without the removed words),
    n_words, n_removed and kept_sha256 (of the kept words joined by a space).

    A word is removed if a window of ``window`` consecutive words that covers
    it starts a second time anywhere in the input. Null, empty and blank texts
    have no words and stay as they are; shorter texts lose nothing. Rows with
    a null id, repeated ids and repeated rows are documents like others (a
    repeated row repeats all its windows). Empty: empty."""
    kind = docs.schema[id_col].dataType.typeName()
    own = F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.lit(None).cast("long")
    text = F.col(text_col).cast("string")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    keyed = docs.select(
        F.coalesce(own, F.xxhash64(F.col(id_col), text)).alias("i"), F.hash(text).alias("x"), text.alias("text"), rest.alias("doc")
    )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            words = Words(utf8(b.column("text")))
            place = np.unique(words.minimizers(k, window)[words.windows(window)])
            if len(place):
                h = words.grams(k, _ODD[1])[place]
                doc = words.doc[place]
                yield _settle(b, h, np.zeros(len(h), np.uint64), doc, place - words.first[doc])

    repeated = _meet(python_tasks(keyed.select("i", "x", "text"), edges, _MOVED), "edges")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            words = Words(utf8(b.column("text")))
            start = words.windows(window)
            on_path = _mask(words, b, "edges")[words.minimizers(k, window)[start]]
            start = start[on_path]
            if len(start):
                doc = words.doc[start]
                h, c = (words.grams(window, base)[start] for base in _ODD[1:])
                yield _settle(b, h, c, doc, start - words.first[doc])

    paths = keyed.join(repeated, ["i", "x"])
    verified = _meet(python_tasks(paths, windows, _MOVED), "cuts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            texts = utf8(b.column("text"))
            words = Words(texts)
            gone = _mask(words, b, "cuts", window)
            kept, digest, n = [], [], np.diff(words.first)
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (n > 0)
            base = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
            for r, t in enumerate(texts):
                own = (t or b"").split()
                if removed[r]:
                    s = slice(words.first[r], words.first[r + 1])
                    keep = ~gone[s]
                    own = [w for w, stays in zip(own, keep) if stays]
                    t = _cut_text(t, words.start[s] - base[r], words.end[s] - base[r], keep)
                kept.append(t)
                digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n), pa.array(removed), pa.array(digest)],
                names=["doc", "text", "n_words", "n_removed", "kept_sha256"],
            )

    out = StructType([
        StructField("doc", keyed.schema["doc"].dataType), StructField("text", StringType()), StructField("n_words", LongType()),
        StructField("n_removed", LongType()), StructField("kept_sha256", StringType()),
    ])
    return python_tasks(keyed.join(verified, ["i", "x"], "left"), remove, out)
