"""Phrase collocations from counting quotient filters (Pandey et al., 2017).

A word's id is the top ``width`` bits of its XXH64 (seeded per run), with the
width (or else the seed) chosen so that no two words of a language share an id;
that is checked over all words, so packed ids are as good as the words. An n-gram
is its ids side by side. An invertible permutation spreads it; the top bits of
the result are the quotient, all other bits the stored remainder, so a counter
loses nothing and the words come back by the inverse permutation.

A task counts the n-grams of a shard of text and writes one filter per language
and segment of the quotient space: unary run lengths per quotient, remainders
bit-packed in order, counts in one byte where they fit. Spark brings the filters
of a segment together and they are merged in order; a frequent n-gram is one
entry per shard, and the permutation deals all n-grams evenly, so no segment is
hot. Segments are so many that one holds a bounded number of occurrences.

Orders are counted one after the other: an n-gram can be frequent only if its
words and its two (n-1)-grams are, and bit tables of fixed size (``TABLE_BITS``)
tell tasks which ones certainly are not. The tables only save work: every n-gram
that is kept has its exact count."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from .common import cut, key_groups, python_tasks

LONGEST = 4
MIN_COUNT = 30
#: A phrase falls when a longer one holds it at least so often (per cent).
COVERED = 80
SCALE = 2_000_000
TOP = 2000
NO_LANGUAGE = "und"
#: Words that a task counts at once, and most occurrences planned per segment.
SHARD_WORDS = 1 << 20
SEGMENT_WORDS = 1 << 21
#: Most bits of a table of frequent hashes (4 MB).
TABLE_BITS = 25
SLICE = 1 << 20
WORD = 8

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(_BREAKS) + b" "
)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _turn(grams: np.ndarray, j: int, step: int, width: int) -> np.ndarray:
    """What round ``step`` adds to word j: a function of the other words."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1, _U)
    for other in range(grams.shape[1]):
        if other != j:
            h = _mix(h + grams[:, other])
    return h >> _U(64 - width)


def permute(grams: np.ndarray, width: int) -> np.ndarray:
    """Bijection on rows of ``width``-bit words (uint64)."""
    out, mask = grams.copy(), _U((1 << width) - 1)
    for step in range(2):
        for j in range(out.shape[1]):
            out[:, j] = (out[:, j] + _turn(out, j, step, width)) & mask
    return out


def restore(spread: np.ndarray, width: int) -> np.ndarray:
    """Inverse of :func:`permute`."""
    out, mask = spread.copy(), _U((1 << width) - 1)
    for step in (1, 0):
        for j in reversed(range(out.shape[1])):
            out[:, j] = (out[:, j] - _turn(out, j, step, width)) & mask
    return out


def _bits(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) bits of each value, highest first."""
    return np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), 8), axis=1)[:, 64 - width :]


def _values(bits: np.ndarray) -> np.ndarray:
    full = np.zeros((len(bits), 64), np.uint8)
    full[:, 64 - bits.shape[1] :] = bits
    return np.packbits(full, axis=1).view(">u8").ravel().astype(_U)


def pack_filter(spread: np.ndarray, counts: np.ndarray, width: int, segment_bits: int, slot_bits: int) -> bytes:
    """Counting quotient filter of one segment: ``spread`` sorted, all with the
    same ``segment_bits`` top bits of the first word; the next ``slot_bits`` are
    the slot. Each slot is as many set bits as it has entries, and a clear one."""
    low = width - segment_bits - slot_bits
    slot = (spread[:, 0] >> _U(low)).astype(np.int64) & (1 << slot_bits) - 1
    runs = np.zeros(len(slot) + (1 << slot_bits), np.uint8)
    runs[np.arange(len(slot)) + slot] = 1
    rest = [_bits(spread[:, 0], low), *(_bits(spread[:, j], width) for j in range(1, spread.shape[1]))]
    large = counts[counts >= 255]
    return b"".join((
        struct.pack("<III", len(slot), len(large), int(spread.shape[1])), np.packbits(runs).tobytes(),
        np.packbits(np.concatenate(rest, axis=1)).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(),
        large.astype("<i8").tobytes(),
    ))


def unpack_filter(blob: bytes, segment: int, width: int, segment_bits: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(spread, counts) as :func:`pack_filter` got them."""
    n, n_large, order = struct.unpack_from("<III", blob)
    raw, at = np.frombuffer(blob, np.uint8), 12
    n_runs = n + (1 << slot_bits)
    runs = np.unpackbits(raw[at : at + -(-n_runs // 8)], count=n_runs)
    at += -(-n_runs // 8)
    slot = (np.flatnonzero(runs) - np.arange(n)).astype(_U)
    low = width - segment_bits - slot_bits
    row = low + (order - 1) * width
    rest = np.unpackbits(raw[at : at + -(-n * row // 8)], count=n * row).reshape(n, row)
    at += -(-n * row // 8)
    counts = raw[at : at + n].astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(blob, "<i8", n_large, at)
    spread = np.empty((n, order), _U)
    spread[:, 0] = (_U(segment) << _U(slot_bits) | slot) << _U(low) | _values(rest[:, :low])
    for j in range(1, order):
        spread[:, j] = _values(rest[:, low + (j - 1) * width : low + j * width])
    return spread, counts


def _sorted(spread: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, equal ones added up. The first word, spread as it is, all
    but decides the order; the others are looked at where it does not."""
    by = np.argsort(spread[:, 0], kind="stable")
    spread, counts = spread[by], counts[by]
    tied = spread[1:, 0] == spread[:-1, 0]
    if tied.any():
        if (spread[1:][tied, 1:] != spread[:-1][tied, 1:]).any():
            by = np.lexsort(spread.T[::-1])
            spread, counts = spread[by], counts[by]
        new = np.append(True, (spread[1:] != spread[:-1]).any(1))
        starts = np.flatnonzero(new)
        spread, counts = spread[starts], np.add.reduceat(counts, starts)
    return spread, counts


def gram_hash(grams: np.ndarray, language: int) -> np.ndarray:
    h = np.full(len(grams), language, _U)
    for j in range(grams.shape[1]):
        h = _mix(h + grams[:, j] * _U(0x9E3779B97F4A7C15))
    return h


class Table:
    """Fixed-size bit table of the hashes of frequent words or n-grams."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> _U(64 - self.bits)
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)

    def holds_one(self, h: int) -> bool:
        at = h >> 64 - self.bits
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)


def _table(hashes: DataFrame, n: int) -> Table:
    """Table of the column ``h``; 16 bits an entry, up to ``TABLE_BITS``."""
    bits = min(max((16 * n).bit_length(), 13), TABLE_BITS)
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = (
        hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()
    )
    words = np.zeros(1 << bits - 6, _U)
    words[rows.column("word").to_numpy()] = rows.column("set").to_numpy().astype(np.int64).view(_U)
    return Table(bits, words)


class _Words(dict):
    """word -> code of a language; -1 ends a phrase (marks, infrequent words)."""

    def __init__(self, language: str, seed: int, width: int, frequent: Table | None):
        super().__init__({b".": -1})
        self.seed = xxhash.xxh64_intdigest(language.encode(), seed)
        self.width, self.frequent = width, frequent
        self.ids: list = []

    def __missing__(self, word: bytes) -> int:
        code = len(self.ids)
        if self.frequent is None:
            self.ids.append(word)
        else:
            h = xxhash.xxh64_intdigest(word, self.seed)
            if self.frequent.holds_one(h):
                self.ids.append(h >> 64 - self.width)
            else:
                code = -1
        self[word] = code
        return code


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in lower case with every mark as ``.``, cut between words."""
    text = text.translate(_TABLE)
    start = 0
    while len(text) - start > SLICE:
        end = start + SLICE
        at = max(text.rfind(b" ", start, end), text.rfind(b".", start, end))
        if at < start:
            after = [p for p in (text.find(b" ", end), text.find(b".", end)) if p >= 0]
            at = min(after) if after else len(text) - 1
        yield text[start : at + 1]
        start = at + 1
    yield text[start:]


class _Shards:
    """Codes of the texts of a task by language; full shards come back."""

    def __init__(self, order: int, make_words, shard_words: int):
        self.order, self.make, self.limit = order, make_words, shard_words
        self.words: dict[str, _Words] = {}
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, language: str, text: bytes) -> Iterator[tuple[str, _Words, np.ndarray]]:
        if language not in self.words:
            self.words[language], self.held[language] = self.make(language), []
        for part in _slices(text):
            tokens = part.replace(b".", b" . ").split()
            code = self.words[language].__getitem__
            self.held[language].append(np.fromiter(map(code, tokens), np.int64, len(tokens)))
            self.size += len(tokens)
            if self.size >= self.limit:
                yield from self.flush(language)
        self.held[language].append(np.array([-1]))

    def flush(self, inside: str | None = None) -> Iterator[tuple[str, _Words, np.ndarray]]:
        """All shards; the language of an unfinished text keeps its last words."""
        for language, held in self.held.items():
            if held:
                codes = np.concatenate(held)
                yield language, self.words[language], codes
                self.held[language] = []
                if len(self.words[language]) > self.limit // 2:
                    tail = codes[len(codes) - self.order + 1 :].tolist()
                    old = self.words[language]
                    self.words[language] = self.make(language)
                    if language == inside and self.order > 1:
                        names = {v: k for k, v in old.items() if v in tail and v >= 0}
                        again = [self.words[language][names[c]] if c >= 0 else -1 for c in tail]
                        self.held[language] = [np.array(again, np.int64)]
                elif language == inside and self.order > 1:
                    self.held[language] = [codes[len(codes) - self.order + 1 :]]
        self.size = sum(len(c) for held in self.held.values() for c in held)


def _language_rows(batches: Iterator[pa.RecordBatch], shards: _Shards):
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for language, text in zip(b.column("lang").to_pylist(), texts):
            yield from shards.add(language, text.as_py())
    yield from shards.flush()


def count_grams(codes: np.ndarray, order: int, n_words: int, may=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``order`` codes without a -1 and how often they occur.
    ``may(starts, order)`` tells which shorter runs, by where they start, can be
    part of one (None: all)."""
    starts = np.arange(len(codes) - order + 1)
    if not len(starts):
        return np.empty((0, order), np.int64), np.empty(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(codes < 0)])
    starts = starts[gaps[order:] == gaps[: len(gaps) - order]]
    if may is not None and len(starts):
        starts = starts[may(starts, order - 1)]
        starts = starts[may(starts + 1, order - 1)]
    if not len(starts):
        return np.empty((0, order), np.int64), np.empty(0, np.int64)
    runs = [codes[starts + j] for j in range(order)]
    names = None
    if order * (n_words + 1).bit_length() > 63:  # number the pairs, so that a key fits
        pairs = runs[0] * n_words + runs[1]
        names, first = np.unique(pairs, return_inverse=True)
        rest = np.unique(runs[2] * n_words + runs[3], return_inverse=True) if order == 4 else (np.arange(n_words), runs[2])
        key = first * len(rest[0]) + rest[1]
    else:
        key = runs[0]
        for r in runs[1:]:
            key = key * n_words + r
    key = np.sort(key)
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    key, counts = key[edges[:-1]], np.diff(edges)
    if names is not None:
        first, last = names[key // len(rest[0])], rest[0][key % len(rest[0])]
        tail = [last // n_words, last % n_words] if order == 4 else [last]
        return np.stack([first // n_words, first % n_words, *tail], axis=1), counts
    found = []
    for _ in range(order):
        found.append(key % n_words)
        key = key // n_words
    return np.stack(found[::-1], axis=1), counts


def _count_words(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(1, lambda language: _Words(language, 0, 64, None), shard_words)
        for language, words, codes in _language_rows(batches, shards):
            counts = np.bincount(codes[codes >= 0], minlength=len(words.ids))
            seen = np.flatnonzero(counts)
            if len(seen):
                yield pa.RecordBatch.from_arrays([
                    pa.array([language] * len(seen), pa.string()),
                    pa.array([words.ids[i] for i in seen], pa.binary()).cast(pa.string()),
                    pa.array(counts[seen]),
                ], names=["lang", "word", "a"])

    return run


def _write_filters(order: int, width: int, seed: int, segment_bits: int, slot_bits: int, frequent, shorter, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = frequent.value, shorter.value if shorter else None
        shards = _Shards(order, lambda language: _Words(language, seed, width, known), shard_words)
        for language, words, codes in _language_rows(batches, shards):
            ids, may = np.array(words.ids, _U), None
            if parts is not None:
                def may(starts, n):
                    return parts.holds(gram_hash(ids[codes[starts[:, None] + np.arange(n)]], words.seed))  # noqa: B023
            rows, counts = count_grams(codes, order, len(ids), may)
            if not len(rows):
                continue
            spread, counts = _sorted(permute(ids[rows], width), counts)
            segment = (spread[:, 0] >> _U(width - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(spread), np.int64)
            edges = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(segment))
            blobs = [pack_filter(spread[a:b], counts[a:b], width, segment_bits, slot_bits) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array([language] * len(blobs), pa.string()), pa.array(segment[edges[:-1]].astype(np.int32)),
                pa.array(blobs, pa.binary()),
            ], names=["lang", "segment", "filter"])

    return run


def _merge_filters(width: int, seed: int, segment_bits: int, slot_bits: int, min_count: int):
    """Frequent n-grams of whole segments: (lang, key, a, h); the key is the word
    ids as 8-byte big-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_groups(batches, ["lang", "segment"]):
            t = whole.combine_chunks()
            where = list(zip(t.column("lang").to_pylist(), t.column("segment").to_pylist()))
            edges = [i for i in range(len(where)) if not i or where[i] != where[i - 1]] + [len(where)]
            for a, b in zip(edges[:-1], edges[1:]):
                language, segment = where[a]
                read = [unpack_filter(x.as_py(), segment, width, segment_bits, slot_bits) for x in t.column("filter")[a:b]]
                spread, counts = _sorted(np.concatenate([s for s, _ in read]), np.concatenate([c for _, c in read]))
                often = counts >= min_count
                if not often.any():
                    continue
                grams = restore(spread[often], width)
                raw = grams.astype(">u8").tobytes()
                size = WORD * grams.shape[1]
                h = gram_hash(grams, xxhash.xxh64_intdigest(language.encode(), seed))
                yield pa.RecordBatch.from_arrays([
                    pa.array([language] * len(grams), pa.string()),
                    pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()),
                    pa.array(counts[often]), pa.array(h.view(np.int64)),
                ], names=["lang", "key", "a", "h"])

    return run


def _word_hash(seed_number: int) -> Column:
    return F.xxhash64(F.lit(seed_number).cast("long"), F.col("lang"), F.col("word"))


def _injective(words: DataFrame, n: int, least: int) -> tuple[int, int]:
    """(seed number, width) for which no two words of a language share an id."""
    width, seed_number = min(64, max(2 * n.bit_length() + 1, least)), 0
    while True:
        shared = words.groupBy("lang", F.shiftrightunsigned(_word_hash(seed_number), 64 - width).alias("i"))
        if shared.agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed_number, width
        if width < 64:
            width = min(64, width + 4)
        else:
            seed_number += 1


def frequent_phrases(
    docs: DataFrame, text_col: str, lang_col: str, longest: int, min_count: int, shard_words: int, segment_words: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, key, a), (phrases of 2 words and more: lang, key, a),
    (lang, n) over all texts; exact counts of what occurs ``min_count`` times."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    partial = python_tasks(rows, _count_words(shard_words), "lang string, word string, a long")
    words = cut(partial.groupBy("lang", "word").agg(F.sum("a").alias("a")))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    size = words.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.count_if(F.col("a") >= min_count)
    ).first()
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segment_bits = (max(least_tasks, -(-size[1] // segment_words)) - 1).bit_length()
    slot_bits = max(0, (shard_words >> segment_bits).bit_length() - 2)
    seed_number, width = _injective(words, size[0], max(24, segment_bits + slot_bits + 1))
    seed = spark.range(1).select(F.xxhash64(F.lit(seed_number).cast("long"))).first()[0] & (1 << 64) - 1

    h = _word_hash(seed_number)
    often = words.where(F.col("a") >= min_count)
    key = F.unhex(F.lpad(F.hex(F.shiftrightunsigned(h, 64 - width)), 2 * WORD, "0"))
    single = often.select("lang", "word", key.alias("key"), "a")
    known = spark.sparkContext.broadcast(_table(often.select(h.alias("h")), size[2]))
    phrases, shorter = None, None
    for order in range(2, longest + 1):
        filters = python_tasks(
            rows, _write_filters(order, width, seed, segment_bits, slot_bits, known, shorter, shard_words),
            "lang string, segment int, filter binary",
        )
        dealt = filters.repartition(max(least_tasks, 1 << segment_bits), "lang", "segment").sortWithinPartitions("lang", "segment")
        found = cut(python_tasks(
            dealt, _merge_filters(width, seed, segment_bits, slot_bits, min_count),
            "lang string, key binary, a long, h long",
        ))
        counted = found.select("lang", "key", "a")
        phrases = counted if phrases is None else phrases.unionByName(counted)
        shorter = spark.sparkContext.broadcast(_table(found.select("h"), found.count()))
    return single, phrases, totals


def _words_in(key: str) -> Column:
    return (F.octet_length(F.col(key)) / WORD).cast("int")


def _part(key: str, start: Column, n: Column) -> Column:
    return F.substring(F.col(key), (start * WORD + 1).cast("int"), (n * WORD).cast("int"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """The ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words that occur ``min_count`` times; score is
    floor(2000000 a / (l + r)) for the cut with the lowest one (ties: the
    shortest first part). A phrase falls if a longer one holding it occurs at
    least ``covered`` per cent as often. Arithmetic is in decimals of 38 digits.
    Null texts are empty, null languages ``und``. Every row counts, repeated or
    not, whatever its id; other columns are ignored. Empty: empty."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest: 2 to {LONGEST} words")
    single, phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count, shard_words, segment_words)
    counts = single.select("lang", "key", "a").unionByName(phrases)

    inner = phrases.withColumn("w", _words_in("key")).where("w > 2")
    inner = inner.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("w") - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("w") - F.col("m"))))
    cover = inner.groupBy("lang", _part("key", F.col("s"), F.col("m")).alias("key")).agg(F.max("a").alias("longer"))
    decimal = "decimal(19,0)"
    falls = F.col("longer").cast(decimal) * 100 >= F.col("a").cast(decimal) * covered
    left = phrases.join(cover, ["lang", "key"], "left").where(~F.coalesce(falls, F.lit(False))).drop("longer")

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), _words_in("key") - 1)))
    cuts = cuts.withColumn("head", _part("key", F.lit(0), F.col("k"))).withColumn(
        "tail", _part("key", F.col("k"), _words_in("key") - F.col("k")))
    heads = counts.select("lang", F.col("key").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("key").alias("tail"), F.col("a").alias("r"))
    rated = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr(
        f"({SCALE}BD * cast(a as {decimal})) div (cast(l as {decimal}) + cast(r as {decimal}))"))
    best = rated.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = cut(best.select("lang", "key", "a", "cut.l", "cut.r", "cut.score"))

    salts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("a")]
    dealt = best.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    first = dealt.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    spelled = (
        first.drop("at", "salt").withColumn("i", F.explode(F.sequence(F.lit(0), _words_in("key") - 1)))
        .withColumn("one", _part("key", F.col("i"), F.lit(1)))
        .join(single.select("lang", F.col("key").alias("one"), "word"), ["lang", "one"])
        .groupBy("lang", "key", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
        .select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    )
    ranked = top_k_per_group(spelled, ["lang"], [*order, F.asc("phrase")], top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
