"""A saved table of named rows (dashboards and the like) with committed versions.

A save writes the whole new version under a name of its own and then commits it by
creating ``_commits/<number>``, which fails if another writer created it first:
nobody's update is lost, the later writer is refused and may read and save again.
Readers take the highest commit, so they never see half a version. Files go
through Spark's writers and Hadoop's file system, on any shared store that creates
files exclusively."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import delete_by_key, get_by_key, list_recent, upsert_by_key


class StaleWriter(RuntimeError):
    """Another writer committed first; read the store again and repeat."""


class KeyedStore:
    """Rows with an id, a unique name, creation and update times and any fields.

    A handle reads the version that was current when it was opened or last
    refreshed, and its saves apply to that one."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"id long, name string, {fields}, created_at timestamp_ntz, updated_at timestamp_ntz"
        self.refresh()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def refresh(self) -> int:
        """Go on from the newest version; its number (0: empty)."""
        self.version = max(self.versions(), default=0)
        return self.version

    def _folder(self, version: int) -> str:
        fs, p = self._fs(f"{self.path}/_commits/{version}")
        stream = fs.open(p)
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of this handle's version, or of an older one."""
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(version))

    def _commit(self, rows: DataFrame) -> int:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/_commits/{self.version + 1}")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if not fs.exists(p):
                raise
            raise StaleWriter(f"version {self.version + 1} of {self.path} is another writer's") from e
        stream.writeUTF(folder)
        stream.close()
        self.version += 1
        return self.version

    def save(self, changes: DataFrame, now: dt.datetime | None = None) -> int:
        """Insert or update by name; the number of the new version. See
        :func:`upsert_by_key` for ids, times and repeated names."""
        return self._commit(upsert_by_key(self.read(), changes, now=now))

    def delete(self, keys: DataFrame, key: str = "id") -> int:
        return self._commit(delete_by_key(self.read(), keys, key))

    def get(self, value, key: str = "id") -> DataFrame:
        return get_by_key(self.read(), value, key)

    def list_all(self) -> DataFrame:
        return list_recent(self.read())

    def clean(self, keep: int = 1) -> None:
        """Remove the data of versions that are superseded, but for the newest
        ``keep``; commits stay, so numbers are never given twice."""
        for v in self.versions()[: -keep or None]:
            fs, p = self._fs(self._folder(v))
            fs.delete(p, True)
