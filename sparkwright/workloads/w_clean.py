"""C01-C11 cleaning workloads on derived nulls / duplicates / dirty text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from . import register, table

# Derived nulls, the same on both sides (all rows kept; the modulo only places nulls).
NULLS_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS odate,
       o_orderpriority
FROM orders
"""


def orders_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 13 != 0, F.col("o_orderdate")).alias("odate"),
        "o_orderpriority",
    )


@register(
    "clean_dedup_full",
    "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F') t",
)
def clean_dedup_full(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.remove_duplicates(o.unionByName(o.where(F.col("o_orderstatus") == "F")))


@register(
    "clean_dedup_subset",
    "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
)
def clean_dedup_subset(spark, sf_dir):
    return C.remove_duplicates(table(spark, sf_dir, "orders"), subset=["o_custkey"], order_by=["o_orderkey"])


@register(
    "clean_fill_numeric_median",
    f"WITH d AS ({NULLS_SQL}) SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)) AS price FROM d",
)
def clean_fill_numeric_median(spark, sf_dir):
    return C.handle_missing_values(orders_nulls(spark, sf_dir).select("o_orderkey", "price"), "auto")


@register(
    "clean_fill_categorical_mode",
    f"""WITH d AS ({NULLS_SQL})
SELECT o_orderkey, coalesce(status, (SELECT status FROM d WHERE status IS NOT NULL GROUP BY status
                                      ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM d""",
)
def clean_fill_categorical_mode(spark, sf_dir):
    return C.handle_missing_values(orders_nulls(spark, sf_dir).select("o_orderkey", "status"), "auto")


@register(
    "clean_ffill_dates",
    f"""WITH d AS ({NULLS_SQL})
SELECT o_orderkey, last_value(odate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS odate
FROM d""",
)
def clean_ffill_dates(spark, sf_dir):
    d = orders_nulls(spark, sf_dir).select("o_orderkey", "odate")
    return C.handle_missing_values(d, "auto", order_by=["o_orderkey"])


@register(
    "clean_drop_any_null",
    f"SELECT * FROM ({NULLS_SQL}) d WHERE price IS NOT NULL AND status IS NOT NULL AND odate IS NOT NULL",
)
def clean_drop_any_null(spark, sf_dir):
    return C.handle_missing_values(orders_nulls(spark, sf_dir), "drop")


@register(
    "clean_fill_constants",
    f"""SELECT o_orderkey, o_custkey, coalesce(price, 0.0) AS price, coalesce(status, 'NA') AS status, odate, o_orderpriority
FROM ({NULLS_SQL}) d""",
)
def clean_fill_constants(spark, sf_dir):
    return C.handle_missing_values(orders_nulls(spark, sf_dir), "fill", {"price": 0.0, "status": "NA"})


@register(
    "clean_drop_empty_rows",
    f"SELECT price, status FROM ({NULLS_SQL}) d WHERE price IS NOT NULL OR status IS NOT NULL",
)
def clean_drop_empty_rows(spark, sf_dir):
    return C.remove_empty_rows(orders_nulls(spark, sf_dir).select("price", "status"), how="all")


SKEW_SQL = """
SELECT o_orderkey, exp(6 * o_totalprice / (SELECT max(o_totalprice) FROM orders)) AS x,
       exp(4 * o_custkey / (SELECT max(o_custkey) FROM orders)) AS z
FROM orders
"""


def orders_skewed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.agg(F.max("o_totalprice").alias("mp"), F.max("o_custkey").alias("mc"))
    return o.crossJoin(F.broadcast(m)).select(
        "o_orderkey",
        F.exp(6 * F.col("o_totalprice") / F.col("mp")).alias("x"),
        F.exp(4 * F.col("o_custkey") / F.col("mc")).alias("z"),
    )


def _iqr_keep(src: str, col: str) -> str:
    return (
        f"(SELECT {src}.* FROM {src}, (SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM {src}) q "
        f"WHERE {col} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"
    )


@register(
    "clean_outliers_iqr",
    f"WITH d AS ({SKEW_SQL}), s AS {_iqr_keep('d', 'x')} SELECT o_orderkey, round(x, 6) AS x FROM s",
)
def clean_outliers_iqr(spark, sf_dir):
    out = C.remove_outliers_iqr(orders_skewed(spark, sf_dir), columns=["x"])
    return out.select("o_orderkey", F.round("x", 6).alias("x"))


@register(
    "clean_outliers_iqr_sequential",
    f"""WITH d AS ({SKEW_SQL}), s1 AS {_iqr_keep('d', 'x')}, s2 AS {_iqr_keep('s1', 'z')}
SELECT o_orderkey, round(x, 6) AS x, round(z, 6) AS z FROM s2""",
)
def clean_outliers_iqr_sequential(spark, sf_dir):
    out = C.remove_outliers_iqr(orders_skewed(spark, sf_dir), columns=["x", "z"])
    return out.select("o_orderkey", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@register(
    "clean_standardize_text",
    "SELECT p_partkey, lower(trim(p_name)) AS name_dirty, lower(trim(p_brand)) AS brand_dirty FROM part",
)
def clean_standardize_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("name_dirty"),
        F.concat(F.lit("\t"), F.col("p_brand"), F.lit("  \n")).alias("brand_dirty"),
    )
    return C.standardize_text_columns(p)


@register(
    "clean_column_names",
    "SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS part_name_1, p_type AS type, p_size AS size FROM part",
)
def clean_column_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Part Key"),
        F.col("p_name").alias("Part Name"),
        F.col("p_brand").alias("part-name"),
        F.col("p_type").alias(" Type! "),
        F.col("p_size").alias("SIZE"),
    )
    return C.clean_column_names(p)


@register(
    "clean_autoparse_dates",
    """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d_text, o_orderpriority AS prio,
       CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed
FROM orders
""",
)
def clean_autoparse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d_text"),
        F.col("o_orderpriority").alias("prio"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
    )
    return C.autoparse_dates(d)


@register(
    "clean_auto",
    f"""
WITH n AS ({NULLS_SQL}),
d0 AS (SELECT o_orderkey AS order_key, price AS total_price, status AS order_status, odate AS order_date FROM n),
d AS (SELECT DISTINCT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE order_status = 'F') u)
SELECT order_key,
       coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM d)) AS total_price,
       coalesce(order_status, (SELECT order_status FROM d WHERE order_status IS NOT NULL GROUP BY order_status
                               ORDER BY count(*) DESC, order_status LIMIT 1)) AS order_status,
       last_value(order_date IGNORE NULLS) OVER (ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_date
FROM d
""",
)
def clean_auto(spark, sf_dir):
    cleaned, _ = C.auto_clean(_messy(spark, sf_dir), order_by=["Order Key"])
    return cleaned


def _messy(spark, sf_dir):
    """Orders with nulls, messy names and repeated rows."""
    n = orders_nulls(spark, sf_dir)
    d = n.select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("price").alias("Total Price"),
        F.col("status").alias("Order-Status"),
        F.col("odate").alias("order date"),
    )
    return d.unionByName(d.where(F.col("`Order-Status`") == "F"))


@register(
    "clean_auto_steps",
    f"""
WITH d0 AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS k, price, status, odate FROM ({NULLS_SQL}) n),
d1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE status = 'F'),
c AS (SELECT (SELECT count(*) FROM d1) AS r, (SELECT count(*) FROM (SELECT DISTINCT * FROM d1) x) AS u,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM d1) y WHERE NOT (k IS NULL AND price IS NULL AND status IS NULL AND odate IS NULL)) AS f)
SELECT CAST(1 AS INTEGER) AS step_no, 'Standardized column names' AS step, r AS rows_before, r AS rows_after FROM c
UNION ALL SELECT 2, 'Removed duplicates', r, u FROM c UNION ALL SELECT 3, 'Removed empty rows', u, f FROM c
UNION ALL SELECT 4, 'Auto-filled missing values', f, f FROM c UNION ALL SELECT 5, 'Parsed date columns', f, f FROM c""",
)
def clean_auto_steps(spark, sf_dir):
    d = _messy(spark, sf_dir)
    key = F.when(F.col("Order Key") % 3 > 0, F.col("Order Key"))
    return C.auto_clean_steps(d.withColumn("Order Key", key))


@register(
    "clean_coerce_numeric_majority",
    """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust_num,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS mostly_text,
       CAST(o_custkey * 1000 + o_orderkey % 1000 AS DOUBLE) AS amount
FROM orders
""",
)
def clean_coerce_numeric_majority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    t = o.select(
        F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("Cust Num"),
        F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.lit("x")).alias("Mostly Text"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")).alias(" Amount"),
    )
    return C.coerce_numeric_majority(t)
