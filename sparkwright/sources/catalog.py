"""Datasets stored as parquet under one shared root, with a temp
view per dataset for SQL. The root defaults to ``<spark.checkpoint.dir>/datasets``
so every executor (and a restarted driver) sees the same files.

A dataset is a folder with a small pointer file that names its current version.
Storing writes a new version beside the old one, switches the pointer, and only
then removes the old version, so a dataset can be stored over itself and a
failed write leaves it as it was. :meth:`Catalog.register` points at a table
that exists elsewhere, without a copy."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import infer_schema
from ..session import ensure_checkpoint_dir

METADATA_SUFFIX = "_metadata"


_UNSAFE = re.compile(r"\W|_")
_POINTER = "_current"


def sanitize_table_name(name: str) -> str:
    """A table name from any text: its runs of letters and digits, lower case,
    joined by one underscore; ``dataset`` stands in where nothing is left, and
    before a leading digit. A leading ``_`` (internal, unlisted) is kept."""
    text = str(name)
    runs = [r for r in _UNSAFE.sub(" ", text.lower()).split(" ") if r]
    if not runs or runs[0][0].isdigit():
        runs.insert(0, "dataset")
    return ("_" if text[:1] == "_" else "") + "_".join(runs)


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or ensure_checkpoint_dir(spark).rstrip("/") + "/datasets").rstrip("/")

    # -- file system helpers (Hadoop FS: works for local, HDFS, object stores)
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _join(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _pointed(self, name: str) -> str | None:
        """Path of the current version, or None."""
        fs, _ = self._fs()
        pointer = self._join(name, _POINTER)
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _point(self, name: str, target: str) -> None:
        """Switch the pointer: written aside, then renamed over the old one."""
        fs, _ = self._fs()
        aside = self._join(name, f"{_POINTER}-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(target.encode()))
        finally:
            stream.close()
        pointer = self._join(name, _POINTER)
        if not fs.rename(aside, pointer):
            fs.delete(pointer, False)
            if not fs.rename(aside, pointer):
                raise OSError(f"cannot switch {pointer}")

    def path(self, name: str) -> str:
        """Folder of the current version of a dataset."""
        name = sanitize_table_name(name)
        found = self._pointed(name)
        if found is None:
            raise FileNotFoundError(f"no dataset {name!r} in {self.root}")
        return found

    # -- S07 / S08
    def store(self, df: DataFrame, name: str, metadata: DataFrame | None = None) -> DataFrame:
        """Write (replacing) the dataset and register its view; returns the stored table."""
        name = sanitize_table_name(name)
        old = self._pointed(name)
        new = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(new)
        self._point(name, new)
        if old and old.startswith(f"{self.root}/{name}/"):
            fs, _ = self._fs()
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)
        if metadata is not None:
            self.store(metadata, name + METADATA_SUFFIX)
        return self.get(name)

    def register(self, name: str, path: str) -> DataFrame:
        """A dataset that points at an existing parquet table; nothing is copied."""
        name = sanitize_table_name(name)
        self._point(name, path)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        name = sanitize_table_name(name)
        df = self.spark.read.parquet(self.path(name))
        df.createOrReplaceTempView(name)
        return df

    # -- S09 / S10
    def list(self) -> list[str]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [n for n in names if not n.endswith(METADATA_SUFFIX) and not n.startswith("_")]

    def exists(self, name: str) -> bool:
        return self._pointed(sanitize_table_name(name)) is not None

    def delete(self, name: str) -> None:
        """Remove the dataset with its metadata; a registered table itself stays."""
        fs, _ = self._fs()
        name = sanitize_table_name(name)
        for n in (name, name + METADATA_SUFFIX):
            fs.delete(self._join(n), True)
        self.spark.catalog.dropTempView(name)

    # -- S11 / S12 / S13
    def describe(self, name: str) -> DataFrame:
        df = self.get(name)
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
        return self.spark.createDataFrame(rows, "column_name string, column_type string, nullable boolean")

    def table_stats(self, names: list[str] | None = None) -> DataFrame:
        """(table_name, row_count, column_count) for each dataset, one union."""
        parts = []
        for n in names or self.list():
            df = self.get(n)
            parts.append(df.select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count")))
        if not parts:
            return self.spark.createDataFrame([], "table_name string, row_count long, column_count long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def preview(self, name: str, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
        df = self.get(name)
        return (df.orderBy(*order_by) if order_by else df).limit(n)

    # -- S16
    def metadata(self, name: str) -> DataFrame | None:
        if not self.exists(name + METADATA_SUFFIX):
            return None
        return self.spark.read.parquet(self.path(name + METADATA_SUFFIX))


def ingest_metadata(df: DataFrame, table_name: str, source: str = "dataframe", file_hash: str | None = None, order_by=None) -> DataFrame:
    """One row (source, table_name, rows, columns, file_hash, schema) where
    schema is an array of per-column structs from :func:`infer_schema`
    (bounded by the column count)."""
    schema = infer_schema(df, order_by=order_by)
    packed = schema.agg(F.sort_array(F.collect_list(F.struct(*schema.columns))).alias("schema"))
    n = df.select(F.count(F.lit(1)).alias("rows"))
    return n.crossJoin(packed).select(
        F.lit(source).alias("source"), F.lit(table_name).alias("table_name"), F.col("rows").cast("long").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(file_hash).cast("string").alias("file_hash"), "schema",
    )
