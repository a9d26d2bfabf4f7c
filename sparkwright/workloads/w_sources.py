"""S01-S18 source, sink, catalog and keyed-table workloads."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.numeric import nonfinite_to_null
from ..operators.upsert import delete_by_key, get_by_key, list_recent, upsert_by_key
from ..session import stage_path
from ..sources import readers as R
from ..sources.catalog import Catalog, ingest_metadata
from ..sources.keyedstore import KeyedStore
from . import register, table


def _scratch(spark, tag: str) -> str:
    return stage_path(spark, f"{tag}-{uuid.uuid4().hex[:10]}")


def _conform(df, like):
    """Cast a re-read frame to the source schema (inferred CSV / JSON types differ)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


@register("src_csv_roundtrip", "SELECT * FROM orders")
def src_csv_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = _scratch(spark, "csv") + "/orders.csv"
    R.write_csv(o, path)
    return _conform(R.read_csv(spark, path), o)


@register("src_csv_quoting", "SELECT doc_id, text, lang FROM documents")
def src_csv_quoting(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks, to CSV and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = _scratch(spark, "quoting") + "/documents.csv"
    R.write_csv(d, path)
    return R.read_csv(spark, path, schema=d.schema, multi_line=True)


@register("src_json_array", "SELECT doc_id, text, lang FROM documents")
def src_json_array(spark, sf_dir):
    """Files that each hold one array of records, cut between elements."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = _scratch(spark, "array") + "/documents.json"
    R.write_json_array(d, path)
    return R.read_any(spark, path).select(*d.columns)


@register("src_json_roundtrip", "SELECT * FROM events")
def src_json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = _scratch(spark, "json") + "/events.json"
    R.write_json(e, path)
    return _conform(R.read_json(spark, path), e)


@register(
    "src_parquet_scan",
    "SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_discount > 0.05",
)
def src_parquet_scan(spark, sf_dir):
    l = R.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    since = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")  # wall-clock literal, independent of the session zone
    return l.where((F.col("l_shipdate") >= since) & (F.col("l_discount") > 0.05)).select(
        "l_orderkey", "l_extendedprice", "l_discount"
    )


@register("src_read_any", "SELECT * FROM customer")
def src_read_any(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = _scratch(spark, "any")
    c.write.mode("overwrite").parquet(base + "/customer.parquet")
    return R.read_any(spark, base + "/customer.parquet")


@register("src_file_hash")
def src_file_hash(spark, sf_dir):
    """Row-only: SHA-256 of every driver parquet file (checked against hashlib in tests)."""
    return R.file_hashes(spark, sf_dir, glob="*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")


@register("cat_store_and_get", "SELECT * FROM orders")
def cat_store_and_get(spark, sf_dir):
    cat = Catalog(spark)
    name = f"orders_{uuid.uuid4().hex[:8]}"
    cat.store(table(spark, sf_dir, "orders"), name)
    return cat.get(name)


def _catalog_with(spark, sf_dir, names):
    """A catalog whose datasets are the given tables themselves (no copies)."""
    cat = Catalog(spark, root=_scratch(spark, "catalog"))
    for n in names:
        cat.register(n, f"{sf_dir.rstrip('/')}/{n}.parquet")
    return cat


@register(
    "cat_list_datasets",
    """SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS row_count
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier)""",
)
def cat_list_datasets(spark, sf_dir):
    """Names and rows of a catalog of three tables; metadata, internal and
    deleted datasets are not listed."""
    cat = _catalog_with(spark, sf_dir, ["orders", "nation", "supplier", "region"])
    cat.store(ingest_metadata(cat.get("nation"), "nation"), "nation_metadata")
    cat.store(cat.get("nation"), "_internal")
    cat.delete("region")
    if cat.exists("region") or not cat.exists("orders"):
        raise RuntimeError("delete removes the dataset it names and no other")
    return cat.table_stats().select(F.col("table_name").alias("name"), "row_count")


@register(
    "cat_describe",
    """SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS column_type,
       "null" = 'YES' AS nullable
FROM (DESCRIBE lineitem)""",
)
def cat_describe(spark, sf_dir):
    """(column_name, column_type, nullable) of a stored table, Spark type names."""
    return _catalog_with(spark, sf_dir, ["lineitem"]).describe("lineitem")


@register(
    "cat_table_stats",
    """SELECT 'customer' AS table_name, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count FROM customer
UNION ALL SELECT 'orders', count(*), CAST(6 AS BIGINT) FROM orders
UNION ALL SELECT 'part', count(*), CAST(6 AS BIGINT) FROM part""",
)
def cat_table_stats(spark, sf_dir):
    return _catalog_with(spark, sf_dir, ["customer", "orders", "part"]).table_stats()


@register("cat_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def cat_preview(spark, sf_dir):
    return _catalog_with(spark, sf_dir, ["orders"]).preview("orders", 10, order_by=["o_orderkey"])


@register(
    "cat_ingest_metadata",
    """SELECT 'dataframe' AS source, 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows, CAST(6 AS BIGINT) AS columns,
       CAST(NULL AS VARCHAR) AS file_hash, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS dtype
FROM (DESCRIBE orders)""",
)
def cat_ingest_metadata(spark, sf_dir):
    m = ingest_metadata(table(spark, sf_dir, "orders"), "orders", order_by=["o_orderkey"])
    each = m.select("source", "table_name", "rows", "columns", "file_hash", F.explode("schema").alias("s"))
    return each.select("source", "table_name", "rows", "columns", "file_hash", "s.column", "s.dtype")


@register(
    "clean_nonfinite_to_null",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS v,
[CASE WHEN o_orderkey % 10 IN (0, 1, 2) THEN NULL ELSE o_totalprice END, NULL, o_totalprice] AS arr
FROM orders""",
)
def clean_nonfinite_to_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    v = (
        F.when(k == 0, F.lit(float("nan")))
        .when(k == 1, F.lit(float("inf")))
        .when(k == 2, F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice"))
    )
    d = o.select("o_orderkey", v.alias("v"), F.array(v, F.lit(float("nan")), F.col("o_totalprice")).alias("arr"))
    return nonfinite_to_null(d)


_NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
_T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _store_base(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("payload"),
        F.col("c_mktsegment").alias("kind"),
        F.lit(str(_T0)).cast("timestamp_ntz").alias("created_at"), F.lit(str(_T0)).cast("timestamp_ntz").alias("updated_at"),
    )


def _changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    s = table(spark, sf_dir, "supplier")
    upd = c.select(F.col("c_name").alias("name"), (F.col("c_acctbal") + 1).alias("payload"), F.lit("updated").alias("kind"))
    new = s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("payload"), F.lit("new").alias("kind"))
    return upd.unionByName(new)


@register(
    "table_upsert",
    """
WITH base AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS payload, c_mktsegment AS kind FROM customer),
ch AS (SELECT c_name AS name, c_acctbal + 1 AS payload, 'updated' AS kind FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT s_name, s_acctbal, 'new' FROM supplier),
j AS (SELECT b.id AS bid, b.name AS bname, b.payload AS bp, b.kind AS bk, ch.name AS cname, ch.payload AS cp, ch.kind AS ck
      FROM base b FULL OUTER JOIN ch ON b.name = ch.name),
m AS (SELECT max(id) AS m FROM base)
SELECT CASE WHEN bname IS NULL THEN (SELECT m FROM m) + row_number() OVER (PARTITION BY bname IS NULL ORDER BY cname) ELSE bid END AS id,
       coalesce(bname, cname) AS name,
       CASE WHEN cname IS NOT NULL THEN cp ELSE bp END AS payload,
       CASE WHEN cname IS NOT NULL THEN ck ELSE bk END AS kind,
       CASE WHEN bname IS NULL THEN TIMESTAMP '2024-06-01 12:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at,
       CASE WHEN cname IS NOT NULL THEN TIMESTAMP '2024-06-01 12:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
FROM j
""",
)
def table_upsert(spark, sf_dir):
    base = _store_base(spark, sf_dir)
    base = base.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    return upsert_by_key(base, _changes(spark, sf_dir), key="name", now=_NOW)


@register(
    "table_get_by_key",
    "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000009'",
)
def table_get_by_key(spark, sf_dir):
    """A saved row by its id and by its name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return get_by_key(c, 7).unionByName(get_by_key(c, "Customer#000000009", "name"))


@register(
    "table_list_recent",
    "SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
)
def table_list_recent(spark, sf_dir):
    """The most recently updated saved rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return list_recent(o).limit(20)


@register(
    "table_delete_by_key",
    "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def table_delete_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    gone = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    return delete_by_key(c, gone, "id")


@register(
    "table_store_versions",
    """
WITH first AS (SELECT row_number() OVER (ORDER BY c_name) AS id, c_name AS name, c_acctbal AS payload FROM customer),
m AS (SELECT max(id) AS m FROM first),
added AS (SELECT (SELECT m FROM m) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name, s_acctbal AS payload FROM supplier)
SELECT id, name, CASE WHEN id % 3 = 0 THEN payload + 1 ELSE payload END AS payload,
       TIMESTAMP '2024-06-01 12:00:00' AS created_at,
       CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-06-02 12:00:00' ELSE TIMESTAMP '2024-06-01 12:00:00' END AS updated_at
FROM first WHERE id % 7 <> 0
UNION ALL SELECT id, name, payload, TIMESTAMP '2024-06-02 12:00:00', TIMESTAMP '2024-06-02 12:00:00' FROM added WHERE id % 7 <> 0
""",
)
def table_store_versions(spark, sf_dir):
    """Save, save again, delete: each a committed version; the last one as read
    by another handle."""
    path = _scratch(spark, "store")
    store = KeyedStore(spark, path, "payload double")
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("payload"))
    store.save(customers, now=dt.datetime(2024, 6, 1, 12))
    third = store.read().where("id % 3 = 0").select("name", (F.col("payload") + 1).alias("payload"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("payload"))
    store.save(third.unionByName(suppliers), now=dt.datetime(2024, 6, 2, 12))
    store.delete(store.read().where("id % 7 = 0").select("id"))
    return KeyedStore(spark, path, "payload double").list_all()
