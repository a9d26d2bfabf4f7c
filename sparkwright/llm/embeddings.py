"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ, Gao
and Long, 2024): each unit vector is rotated, its signs are its code, and the
stored factor <code, vector> turns a code's inner product into an unbiased
estimate with a confidence bound. Pairs whose bound reaches the threshold are
recomputed exactly in double precision; only those links count.

Which pairs meet: the sign codes of ``ROTATIONS`` rotations are cut into
16-bit bands; two vectors of one label are compared if a band agrees. At
cosine 0.98 a sign differs with probability 0.064, so a band agrees with
probability 0.35 and a pair meets in none of 24 bands with 4e-5; closer pairs
meet more surely. A pair is counted in the first band it agrees on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import connected_components, cut, group_bounds, key_groups, python_tasks, shared_keys, tiles, unite

THRESHOLD = 0.98
BANDS = 24
BAND_BITS = 16
#: Width of the confidence bound in standard errors of the estimate.
EPSILON = 5.0
TILE_ROWS = 512


@lru_cache(maxsize=64)
def _rotation(dim: int, number: int) -> np.ndarray:
    """Orthonormal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that neither tiny
    nor huge components over- or underflow."""
    v = flat.reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def band_codes(unit: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) 16-bit codes: signs under successive rotations."""
    dim = unit.shape[1]
    rotations = -(-bands * BAND_BITS // dim)
    signs = np.concatenate([unit @ _rotation(dim, i) > 0 for i in range(rotations)], axis=1)[:, : bands * BAND_BITS]
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint16).astype(np.int32)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RaBitQ estimates of all inner products between the unit vectors ``a``
    (rotated, full precision) and the codes of ``b``; and their standard error."""
    dim = a.shape[1]
    q = _rotation(dim, 0)
    turned = b @ q
    codes = np.where(turned > 0, 1.0, -1.0) / np.sqrt(dim)
    factor = np.einsum("ij,ij->i", codes, turned)  # the stored correction
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    return ((a @ q) @ codes.T) / factor, error


def _compare(unit, codes, copies, tile, band, threshold, epsilon):
    """Links of one comparison task: (row indexes, links gained, root index)."""
    n = len(unit)
    labels, gained = np.arange(n), np.zeros(n, np.int64)
    sides = [np.flatnonzero(tile == t) for t in np.unique(tile)]
    left, right = sides[0], sides[-1]
    est, error = estimate(unit[left], unit[right])
    x, y = np.nonzero(est + epsilon * error >= threshold)
    if len(sides) == 1:
        x, y = x[x < y], y[x < y]
    x, y = left[x], right[y]
    if band:  # counted in an earlier band already
        fresh = ~(codes[x, :band] == codes[y, :band]).any(axis=1)
        x, y = x[fresh], y[fresh]
    exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
    x, y = x[exact], y[exact]
    np.add.at(gained, x, copies[y])
    np.add.at(gained, y, copies[x])
    unite(labels, x, y)
    hit = np.flatnonzero(gained)
    return hit, gained[hit], labels[hit]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    epsilon: float = EPSILON,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per input row: (``id_col``, n_links, component, kept).

    n_links counts the other rows linked directly, component is the smallest
    id reachable (itself included), kept tells whether that is the row's own.
    Null labels, null, empty or zero vectors and those with null or non-finite
    components link with nothing (component: own id). Vectors of different
    lengths never link. Equal vectors of a label are one node with a count, so
    large groups of copies cost nothing. Rows with a null id: linked and
    counted, but they name no component and are not kept. Repeated ids: each
    row counts as a vector. Other columns are ignored. Empty: empty."""
    v = F.col(vector_col)
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    usable = (
        F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (top > 0) & (top < float("inf"))
    )
    rows = cut(vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        v.cast("array<double>").alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"),
    ))
    nodes = (
        rows.where("usable")
        .groupBy("label", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id())
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vector").to_pylist()
            size = np.array([len(x) for x in vec])
            out = np.zeros((len(vec), bands), np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                out[at] = band_codes(_units(np.concatenate([vec[i] for i in at]), int(d)), bands)
            codes = pa.ListArray.from_arrays(
                np.arange(0, out.size + 1, bands, dtype=np.int32), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*b.columns, codes], names=[*b.schema.names, "codes"])

    kind = StructType([*nodes.schema.fields, StructField("codes", ArrayType(IntegerType()))])
    nodes = cut(python_tasks(nodes, code, kind))

    keyed = nodes.select(
        "node", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("band", "code")
    )
    group = ["label", "dim", "band", "code"]
    split = F.ceil(F.col("n") / tile_rows)
    dealt = tiles(shared_keys(keyed, group), F.pmod(F.xxhash64("node"), split), F.sequence(F.lit(0).cast("long"), split - 1))
    task = F.xxhash64(*group, "ti", "tj")
    keys = ["task", "ti", "tj"]
    dealt = dealt.select("node", "band", "tile", "ti", "tj", task.alias("task"))
    fat = dealt.join(nodes.select("node", "copies", "vector", "codes"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_groups(batches, keys):
            node, tile, band = (t.column(c).to_numpy() for c in ("node", "tile", "band"))
            ti, tj, copies = (t.column(c).to_numpy() for c in ("ti", "tj", "copies"))
            vectors_, codes_ = t.column("vector").combine_chunks(), t.column("codes").combine_chunks()
            out = []
            for s, e in group_bounds(t, keys):
                if e - s < 2 or (ti[s] != tj[s] and tile[s] == tile[e - 1]):
                    continue
                flat = vectors_.slice(s, e - s).flatten().to_numpy()
                unit = _units(flat, len(flat) // (e - s))
                codes = codes_.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                hit, gained, root = _compare(unit, codes, copies[s:e], tile[s:e], int(band[s]), threshold, epsilon)
                if len(hit):
                    out.append((node[s:e][hit], gained, node[s:e][root]))
            if out:
                a, n, r = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(r)], names=["node", "gained", "root"])

    ordered = fat.repartition(*keys).sortWithinPartitions(*keys, "tile")
    found = cut(python_tasks(ordered, run, "node long, gained long, root long"))
    roots = connected_components(found, "node", "root").withColumnRenamed("node", "member")
    gained = found.groupBy("node").agg(F.sum("gained").alias("gained"))
    placed = (
        nodes.select("node", "label", "vector", "copies", "low")
        .join(gained, "node", "left")
        .join(roots, F.col("node") == F.col("member"), "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    placed = placed.join(lowest, "root").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("links"), "component"
    )
    linked = rows.where("usable").join(placed, ["label", "vector"]).select("id", "links", "component")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("links").alias("n_links"),
        "component",
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
