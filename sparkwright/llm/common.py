"""Shared pieces of the training-data operators: lineage cuts, Arrow batches
regrouped by key, bounded comparison tiles and connected components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, ship_package

#: Word separators of every contract of this subpackage: space and \x09-\x0D,
#: which is also what ``bytes.split()`` splits on.
SPACES = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder named by ``spark.checkpoint.dir``
    and go on from there: a lost executor recomputes nothing before this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_tasks(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return text.split() if text else []


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that each table holds whole key groups.

    At most one batch and one unfinished group are held; callers bound the
    group (comparison tiles), never the data."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        changed[0] = last is not None and first != last
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        starts = np.flatnonzero(changed)
        if not len(starts):
            held.append(batch)
            continue
        if held or starts[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))])
        held = [batch.slice(int(starts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each run of equal keys in a sorted table."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(changed)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))


def shared_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key occurs at least twice, with the count as ``n``.

    The count combines map-side; the join back is an ordinary shuffle join, so
    AQE splits the partition of a hot key."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counts, keys)


def tiles(rows: DataFrame, tile: Column, partners: Column) -> DataFrame:
    """Deal rows to comparison tasks (``ti``, ``tj``), ``ti <= tj``.

    ``tile`` is a row's own tile and ``partners`` the array of tiles it has to
    meet (itself among them), so a group of n rows becomes tasks of bounded
    size, whatever n is."""
    return (
        rows.withColumn("tile", tile)
        .withColumn("other", F.explode(partners))
        .withColumn("ti", F.least("tile", "other"))
        .withColumn("tj", F.greatest("tile", "other"))
        .drop("other")
    )


def bounded_sample(rows: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows, the first by a hash of ``keys``. Where there are
    more, a filter on the hash leaves a tenth more than wanted first, so no task
    passes on more than its share, however many tasks there are."""
    n = rows.count()
    if n > bound:
        wanted = int((1 << 24) * 1.1 * bound / n) + 1
        rows = rows.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 24)) < wanted)
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(bound)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the index pairs (a, b) in ``labels``: every entry
    ends as the smallest index of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Component of each node of an edge list: (``node``, ``root``), root the
    smallest node of the component; nodes without an edge are absent.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    is a minimum per node (combined map-side) joined back to the edges, so a
    node of any degree is split by AQE. A round ends in a checkpoint; the only
    thing sent to the driver is a count and a checksum."""
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = cut(e)
    state = _checksum(e)
    for _ in itertools.count():
        if state[0] == 0:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        new = _checksum(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _checksum(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(r)
