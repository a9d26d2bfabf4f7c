"""E01-E07 pipeline workloads. The flagship ``pipe_full_etl`` is ``entry()``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.pipeline import Pipeline
from ..sources.catalog import Catalog
from ..session import stage_path
from . import register, table
from .w_clean import NULLS_SQL, orders_nulls


def _dirty(spark, sf_dir):
    """Orders with derived nulls, messy headers and repeated rows."""
    n = orders_nulls(spark, sf_dir)
    d = n.select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("price").alias("Total Price"),
        F.col("status").alias("Order-Status"),
        F.col("odate").alias("order date"),
        F.col("o_custkey").cast("string").alias("Cust Ref"),
    )
    return d.unionByName(d.where(F.col("`Order-Status`") == "F"))


def _pipeline(spark):
    return Pipeline(spark, Catalog(spark, root=stage_path(spark, f"etl-{uuid.uuid4().hex[:10]}")))


_CLEAN_SQL = f"""
WITH n AS ({NULLS_SQL}),
d0 AS (SELECT o_orderkey AS order_key, price AS total_price, status AS order_status, odate AS order_date,
              CAST(o_custkey AS VARCHAR) AS cust_ref FROM n),
d AS (SELECT DISTINCT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE order_status = 'F') u),
c AS (
SELECT order_key,
       coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM d)) AS total_price,
       coalesce(order_status, (SELECT order_status FROM d WHERE order_status IS NOT NULL GROUP BY order_status
                               ORDER BY count(*) DESC, order_status LIMIT 1)) AS order_status,
       last_value(order_date IGNORE NULLS) OVER (ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_date,
       cust_ref
FROM d)"""

_W = "OVER (ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_W3 = "OVER (ORDER BY order_key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"

_FULL_SQL = (
    _CLEAN_SQL
    + f"""
SELECT order_key, total_price, order_status, order_date, CAST(cust_ref AS BIGINT) AS cust_ref,
       round(sum(total_price) {_W}, 2) AS total_price_cumsum, max(total_price) {_W} AS total_price_cummax,
       min(total_price) {_W} AS total_price_cummin,
       CASE WHEN count(total_price) {_W3} = 3 THEN round(avg(total_price) {_W3}, 4) END AS total_price_rolling_avg_3,
       CAST(year(order_date) AS INTEGER) AS order_date_year, CAST(month(order_date) AS INTEGER) AS order_date_month,
       CAST(day(order_date) AS INTEGER) AS order_date_day, CAST(quarter(order_date) AS INTEGER) AS order_date_quarter,
       CAST(isodow(order_date) - 1 AS INTEGER) AS order_date_dayofweek
FROM c"""
)


@register("pipe_full_etl", _FULL_SQL)
def pipe_full_etl(spark, sf_dir):
    """Flagship: ingest -> clean -> transform -> features, each stage written
    to the shared folder before the next reads it."""
    p = _pipeline(spark)
    res = p.run_full_etl(
        df=_dirty(spark, sf_dir), name="orders_raw", numeric_columns=["total_price"], date_columns=["order_date"], order_by=["Order Key"],
        profile=False,  # pipe_full_etl_profile checks it
    )
    if res["status"] != "success":
        raise RuntimeError(res["error"])
    f = res["final"]
    return f.withColumn("total_price_cumsum", F.round("total_price_cumsum", 2)).withColumn(
        "total_price_rolling_avg_3", F.round("total_price_rolling_avg_3", 4)
    )


@register("pipe_cleaning", _CLEAN_SQL + " SELECT * FROM c")
def pipe_cleaning(spark, sf_dir):
    p = _pipeline(spark)
    p.run_ingestion(df=_dirty(spark, sf_dir), name="orders_raw")
    return p.run_cleaning("orders_raw", order_by=["Order Key"])["table"]


@register(
    "pipe_transformation",
    "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust_ref, o_totalprice AS price_text, o_orderpriority FROM orders",
)
def pipe_transformation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust_ref"), F.col("o_totalprice").cast("string").alias("price_text"), "o_orderpriority"
    )
    p = _pipeline(spark)
    p.run_ingestion(df=o, name="orders_text")
    return p.run_transformation("orders_text")["table"]


@register(
    "pipe_features",
    f"""SELECT o_orderkey, o_totalprice, o_orderdate,
round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS o_totalprice_cumsum,
max(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_totalprice_cummax,
min(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_totalprice_cummin,
round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) * CASE WHEN row_number() OVER (ORDER BY o_orderkey) >= 3 THEN 1 END AS o_totalprice_rolling_avg_3,
CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek
FROM orders""",
)
def pipe_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    p = _pipeline(spark)
    p.run_ingestion(df=o, name="orders_num")
    f = p.run_feature_engineering("orders_num", ["o_totalprice"], ["o_orderdate"], order_by=["o_orderkey"])["table"]
    return f.withColumn("o_totalprice_cumsum", F.round("o_totalprice_cumsum", 2)).withColumn(
        "o_totalprice_rolling_avg_3", F.round("o_totalprice_rolling_avg_3", 4)
    )


@register(
    "pipe_history",
    """SELECT * FROM (VALUES ('ingestion', 'completed', 'orders_raw'), ('cleaning', 'completed', 'orders_raw_cleaned'),
('transformation', 'completed', 'orders_raw_cleaned_transformed'),
('feature_engineering', 'completed', 'orders_raw_cleaned_transformed_features')) t(step, status, table_name)
WHERE (SELECT count(*) FROM orders) > 0""",
)
def pipe_history(spark, sf_dir):
    """The history table of a full run over orders, as a second session would read it."""
    p = _pipeline(spark)
    p.run_full_etl(df=_dirty(spark, sf_dir), name="orders_raw", numeric_columns=["total_price"], order_by=["Order Key"], profile=False)
    return Pipeline(spark, Catalog(spark, root=p.catalog.root)).history_frame().select("step", "status", "table_name")


@register(
    "pipe_full_etl_profile",
    f"""
WITH f AS ({_FULL_SQL})
SELECT (SELECT count(*) FROM f) AS rows, CAST(14 AS BIGINT) AS columns, (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS distinct_rows,
       (SELECT round(avg(total_price), 4) FROM f) AS mean_price, (SELECT round(quantile_cont(total_price, 0.5), 4) FROM f) AS median_price,
       (SELECT count(*) - count(order_date) FROM f) AS missing_dates, (SELECT round(corr(total_price, cust_ref), 6) FROM f) AS corr_price_cust""",
)
def pipe_full_etl_profile(spark, sf_dir):
    """The profile that belongs to the result of every full run."""
    p = _pipeline(spark)
    res = p.run_full_etl(
        df=_dirty(spark, sf_dir), name="orders_raw", numeric_columns=["total_price"], date_columns=["order_date"], order_by=["Order Key"]
    )
    if res["status"] != "success":
        raise RuntimeError(res["error"])
    prof = res["profile"]
    price = F.col("column") == "total_price"
    over = prof["overview"].select("rows", "columns", (F.col("rows") - F.col("duplicate_rows")).alias("distinct_rows"))
    stats = prof["numeric_stats"].where(price).select(F.round("mean", 4).alias("mean_price"), F.round("p50", 4).alias("median_price"))
    miss = prof["missing"].where(F.col("column") == "order_date").select(F.col("missing_count").alias("missing_dates"))
    corr = prof["correlation"].where("col1 = 'total_price' AND col2 = 'cust_ref'").select(F.round("corr", 6).alias("corr_price_cust"))
    return over.crossJoin(stats).crossJoin(miss).crossJoin(corr)  # one row each
