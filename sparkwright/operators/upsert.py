"""Keyed upsert / delete on a table (the saved-dashboard store pattern)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix


def upsert_by_key(
    base: DataFrame,
    changes: DataFrame,
    key: str = "name",
    id_col: str = "id",
    created_col: str = "created_at",
    updated_col: str = "updated_at",
    now: dt.datetime | None = None,
) -> DataFrame:
    """Rows of ``changes`` replace the fields of the base row with the same key
    (keeping its id and creation time); new keys get ids ``max(id) + 1, +2 ...``
    in key order; other base rows stay. A null key is a key like others. Of
    several changes with one key the greatest row (by its fields in column
    order, nulls first) counts, so a key never doubles. One full outer join; the
    new ids come from a distributed running count, not a single-partition window."""
    now = now or dt.datetime.now()
    fields = [c for c in changes.columns if c != key]
    one = changes.groupBy(F.col(key).alias("c_" + key)).agg(F.max(F.struct(*[F.col(f).alias("c_" + f) for f in fields])).alias("__f"))
    c = one.select("c_" + key, "__f.*", F.lit(True).alias("__changed"))
    b = base.select(*[F.col(x).alias("b_" + x) for x in base.columns], F.lit(True).alias("__base"))
    j = b.join(c, F.col("b_" + key).eqNullSafe(F.col("c_" + key)), "full_outer")
    is_new, changed = F.col("__base").isNull(), F.col("__changed").isNotNull()
    max_id = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m"))
    new = j.where(is_new).select(F.col("c_" + key).alias(key))
    ranked = prefix.running(new.withColumn("__one", F.lit(1)), {"__rn": ("count", "__one")}, [key], keep_null_rows=False)
    new_ids = ranked.crossJoin(F.broadcast(max_id)).select(
        F.col(key).alias("__nk"), (F.col("m") + F.col("__rn")).alias("__nid"), F.lit(True).alias("__new")
    )
    j = j.join(new_ids, F.col("c_" + key).eqNullSafe(F.col("__nk")) & is_new.eqNullSafe(F.col("__new")), "left")
    ts_type = base.schema[updated_col].dataType
    # a wall-clock literal for NTZ columns, independent of the session time zone
    ts = F.lit(now.isoformat(sep=" ")).cast(ts_type) if ts_type.typeName() == "timestamp_ntz" else F.lit(now).cast(ts_type)
    out = []
    for col in base.columns:
        if col == id_col:
            v = F.when(is_new, F.col("__nid").cast(base.schema[id_col].dataType)).otherwise(F.col("b_" + id_col))
        elif col == key:
            v = F.when(is_new, F.col("c_" + key)).otherwise(F.col("b_" + key))
        elif col == created_col:
            v = F.when(is_new, ts).otherwise(F.col("b_" + created_col))
        elif col == updated_col:
            v = F.when(changed, ts).otherwise(F.col("b_" + updated_col))
        elif col in fields:
            v = F.when(changed, F.col("c_" + col)).otherwise(F.col("b_" + col))
        else:
            v = F.when(is_new, F.lit(None)).otherwise(F.col("b_" + col))
        out.append(v.cast(base.schema[col].dataType).alias(col))
    return j.select(*out)


def delete_by_key(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``keys`` (left anti join)."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def list_recent(base: DataFrame, updated_col: str = "updated_at", id_col: str = "id") -> DataFrame:
    return base.orderBy(F.col(updated_col).desc(), F.col(id_col).desc())


def get_by_key(base: DataFrame, value, key: str = "id") -> DataFrame:
    """The rows whose ``key`` (id or name) is ``value``."""
    return base.where(F.col(key).eqNullSafe(F.lit(value)))
