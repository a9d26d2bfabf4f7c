"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by
tiled exact comparison (numpy exclusive-or and bit counts).

Which tiles meet: with radius r the 64 bits are cut into ``blocks`` blocks;
two fingerprints within r bits agree on at least ``blocks - r`` whole blocks,
so every link shares one of the C(blocks, r) block combinations. Rows of one
combination are compared exactly, tile by tile; tile pairs whose population
counts differ by more than r are skipped (and never dealt out)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    SPACES,
    connected_components,
    cut,
    group_bounds,
    key_groups,
    python_tasks,
    shared_keys,
    tiles,
    unite,
    utf8,
    words_of,
)

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 5
TILE_ROWS = 1024
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a text (UTF-8): a bit is 1 if set in over half of the hashes
    of its shingles, repeats included. Fewer words than a shingle: the whole
    sequence is one; no word (also null): zero."""
    words = words_of(text.lower() if text else None)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        runs = [words[at + i : end + i] for i in range(shingle)]
        h = np.array([hash64(b" ".join(s), 42) for s in zip(*runs)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(``id_col``, fp long) of every row; whole texts, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return python_tasks(rows, run, f"id {kind}, fp long")


def _masks(blocks: int, radius: int) -> list[int]:
    """Masks of all combinations of ``blocks - radius`` whole blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(fp: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fp, fp) joining the classes of one comparison task. Rows of
    two tiles are compared across them, rows of one tile with each other."""
    labels = np.arange(len(fp))
    count = np.bitwise_count(fp).astype(np.int16)
    sides = [np.flatnonzero(tile == t) for t in np.unique(tile)]
    for rows in sides:
        rows[:] = rows[np.argsort(count[rows], kind="stable")]
    left, right = sides[0], sides[-1]
    step = 512
    for i in range(0, len(left), step):
        a = left[i : i + step]
        for j in range(i if len(sides) == 1 else 0, len(right), step):
            b = right[j : j + step]
            if count[b[0]] - count[a[-1]] > radius or count[a[0]] - count[b[-1]] > radius:
                continue  # every pair differs in more bits than the radius
            near = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius
            x, y = np.nonzero(near)
            unite(labels, a[x], b[y])
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[moved], fp[labels[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of the graph "at most ``radius``
    differing bits" over the distinct ``fp`` of ``nodes``; a dense group gives
    edges in proportion to its rows and tiles, not to its pairs."""
    masks = _masks(blocks, radius)
    keyed = nodes.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("band", "key"),
    )
    split = F.ceil(F.col("n") / tile_rows)  # 1: the group is one tile
    bits = F.bit_count("fp")
    own = F.when(split == 1, F.lit(0).cast("long")).otherwise(bits * split + F.pmod(F.xxhash64("fp"), split))
    low, high = F.greatest(bits - radius, F.lit(0)) * split, (F.least(bits + radius, F.lit(64)) + 1) * split - 1
    meets = F.when(split == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))
    keys = ["band", "key", "ti", "tj"]
    tasks = tiles(shared_keys(keyed, ["band", "key"]), own, meets).select(*keys, "tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_groups(batches, keys):
            fp, tile = t.column("fp").to_numpy().view(np.uint64), t.column("tile").to_numpy()
            ti, tj = t.column("ti").to_numpy(), t.column("tj").to_numpy()
            out = []
            for s, e in group_bounds(t, keys):
                one = tile[s:e]
                if e - s > 1 and (ti[s] == tj[s] or one[0] != one[-1]):
                    out.append(_compare(fp[s:e], one, radius))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = tasks.repartition(*keys).sortWithinPartitions(*keys, "tile")
    return python_tasks(ordered, run, "a long, b long")


def _placed(fps: DataFrame, radius: int, blocks: int, tile_rows: int) -> DataFrame:
    """(fp, low, root) of every distinct ``fp``: its smallest id and the
    fingerprint that names its component."""
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(nodes, radius, blocks, tile_rows), "a", "b")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(``id_col``, fp long, component): component is the smallest id linked,
    directly or through others, by fingerprints at ``radius`` or fewer bits.

    Nodes are distinct fingerprints, so copies cost one node however many they
    are. Null ids: the row gets its component, its id never names one (a
    component of null ids only is null). Null, empty and blank texts: zero,
    linked like any other. Repeated rows and ids: each row gets its component.
    Other columns of ``docs`` are ignored, whatever their names. Empty: empty."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    placed = _placed(fps, radius, blocks, tile_rows)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    component = placed.join(lowest, "root").select("fp", "component")
    return fps.join(component, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` that lead their group: of each component the rows with
    its smallest id (repeated ids all stay). Rows with a null id cannot be
    named by a group and stay."""
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, **how)
    leads = found.where(F.col(id_col) == F.col("component")).select(F.col(id_col).alias("__lead")).distinct()
    joined = docs.join(leads, F.col(id_col) == F.col("__lead"), "left")
    return joined.where(F.col(id_col).isNull() | F.col("__lead").isNotNull()).drop("__lead")


def keep_one_row(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row of ``docs`` per component: the one with its smallest id (null ids
    last), of several the first by a row key. The key is written once before it
    is used, so retries agree on it. Repeated rows and ids and null ids are
    documents like others, only rows that have a null id and no word all stay:
    nothing names them and no text stands twice. Empty: empty."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), doc.alias("doc")))
    own, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col).cast("string")
    rank = F.struct(own.isNull().alias("absent"), own.alias("id"), "key")
    fps = cut(fingerprints(keyed.select(rank.alias("rank"), text.alias("text")), "rank", "text", shingle))
    leads = _placed(fps, radius, blocks, tile_rows).groupBy("root").agg(F.min("low").alias("lead"))
    leads = leads.select(F.col("lead.key").alias("key"), F.lit(True).alias("leads"))
    bare = own.isNull() & (F.coalesce(F.length(F.btrim(text, F.lit(SPACES))), F.lit(0)) == 0)
    return keyed.join(leads, "key", "left").where(F.col("leads") | bare).select("doc.*")
