"""F01-F08 feature workloads (ordered by the unique o_orderkey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from . import register, table
from .w_clean import NULLS_SQL, orders_nulls

ORDER = ["o_orderkey"]


def _nulls(spark, sf_dir):
    return orders_nulls(spark, sf_dir).select("o_orderkey", "o_custkey", "price")


def _w(part: str = "", frame: str = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"OVER ({p}ORDER BY o_orderkey {frame})"


@register(
    "feat_ratio",
    "SELECT o_orderkey, round(coalesce(o_totalprice / nullif(o_custkey % 5, 0), 0), 6) AS o_totalprice_to_den_ratio FROM orders",
)
def feat_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 5).alias("den"))
    r = FE.create_ratios(o, "o_totalprice", "den")
    return r.select("o_orderkey", F.round("o_totalprice_to_den_ratio", 6).alias("o_totalprice_to_den_ratio"))


@register(
    "feat_running_total",
    f"SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL ELSE round(sum(price) {_w()}, 2) END AS price_running_total FROM ({NULLS_SQL}) d",
)
def feat_running_total(spark, sf_dir):
    r = FE.create_running_total(_nulls(spark, sf_dir), "price", ORDER)
    return r.select("o_orderkey", F.round("price_running_total", 2).alias("price_running_total"))


@register(
    "feat_running_total_grouped",
    f"""SELECT o_orderkey, o_custkey,
CASE WHEN price IS NULL THEN NULL ELSE round(sum(price) {_w('o_custkey')}, 2) END AS price_running_total FROM ({NULLS_SQL}) d""",
)
def feat_running_total_grouped(spark, sf_dir):
    r = FE.create_running_total(_nulls(spark, sf_dir), "price", ORDER, group_by="o_custkey")
    return r.select("o_orderkey", "o_custkey", F.round("price_running_total", 2).alias("price_running_total"))


@register(
    "feat_lag",
    f"SELECT o_orderkey, lag(price, 2) OVER (ORDER BY o_orderkey) AS price_lag_2 FROM ({NULLS_SQL}) d",
)
def feat_lag(spark, sf_dir):
    return FE.create_lag(_nulls(spark, sf_dir), "price", 2, ORDER).select("o_orderkey", "price_lag_2")


@register(
    "feat_lag_grouped",
    f'SELECT o_orderkey, lead(price, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "price_lag_-1" FROM ({NULLS_SQL}) d',
)
def feat_lag_grouped(spark, sf_dir):
    return FE.create_lag(_nulls(spark, sf_dir), "price", -1, ORDER, group_by="o_custkey").select("o_orderkey", "price_lag_-1")


def _pct_sql(part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"""
WITH f AS (SELECT o_orderkey, o_custkey, last_value(price IGNORE NULLS) {_w(part)} AS ff FROM ({NULLS_SQL}) d)
SELECT o_orderkey, round((ff / nullif(lag(ff, 1) OVER ({p}ORDER BY o_orderkey), 0) - 1) * 100, 6) AS price_pct_change_1 FROM f
"""


@register("feat_pct_change", _pct_sql(""))
def feat_pct_change(spark, sf_dir):
    r = FE.create_pct_change(_nulls(spark, sf_dir), "price", 1, ORDER)
    return r.select("o_orderkey", F.round("price_pct_change_1", 6).alias("price_pct_change_1"))


@register("feat_pct_change_grouped", _pct_sql("o_custkey"))
def feat_pct_change_grouped(spark, sf_dir):
    r = FE.create_pct_change(_nulls(spark, sf_dir), "price", 1, ORDER, group_by="o_custkey")
    return r.select("o_orderkey", F.round("price_pct_change_1", 6).alias("price_pct_change_1"))


_W3 = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"


@register(
    "feat_rolling_avg",
    f"""SELECT o_orderkey, CASE WHEN count(price) {_w('', _W3)} = 3 THEN round(avg(price) {_w('', _W3)}, 4) END AS price_rolling_avg_3
FROM ({NULLS_SQL}) d""",
)
def feat_rolling_avg(spark, sf_dir):
    r = FE.create_rolling_avg(_nulls(spark, sf_dir), "price", 3, ORDER)
    return r.select("o_orderkey", F.round("price_rolling_avg_3", 4).alias("price_rolling_avg_3"))


@register(
    "feat_cumulative",
    f"""SELECT o_orderkey,
CASE WHEN price IS NULL THEN NULL ELSE round(sum(price) {_w()}, 2) END AS price_cumsum,
CASE WHEN price IS NULL THEN NULL ELSE max(price) {_w()} END AS price_cummax,
CASE WHEN price IS NULL THEN NULL ELSE min(price) {_w()} END AS price_cummin
FROM ({NULLS_SQL}) d""",
)
def feat_cumulative(spark, sf_dir):
    r = FE.create_cumulative_metrics(_nulls(spark, sf_dir), "price", ORDER)
    return r.select("o_orderkey", F.round("price_cumsum", 2).alias("price_cumsum"), "price_cummax", "price_cummin")


@register(
    "feat_cyclical",
    """SELECT p_partkey, p_size, round(sin(2 * pi() * p_size / (SELECT max(p_size) FROM part)), 6) AS p_size_sin,
round(cos(2 * pi() * p_size / (SELECT max(p_size) FROM part)), 6) AS p_size_cos FROM part""",
)
def feat_cyclical(spark, sf_dir):
    p = FE.encode_cyclical_features(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")
    return p.select("p_partkey", "p_size", F.round("p_size_sin", 6).alias("p_size_sin"), F.round("p_size_cos", 6).alias("p_size_cos"))


@register(
    "feat_generate",
    f"""SELECT o_orderkey, price, odate,
CASE WHEN price IS NULL THEN NULL ELSE round(sum(price) {_w()}, 2) END AS price_cumsum,
CASE WHEN price IS NULL THEN NULL ELSE max(price) {_w()} END AS price_cummax,
CASE WHEN price IS NULL THEN NULL ELSE min(price) {_w()} END AS price_cummin,
CASE WHEN count(price) {_w('', _W3)} = 3 THEN round(avg(price) {_w('', _W3)}, 4) END AS price_rolling_avg_3,
CAST(year(odate) AS INTEGER) AS odate_year, CAST(month(odate) AS INTEGER) AS odate_month, CAST(day(odate) AS INTEGER) AS odate_day,
CAST(quarter(odate) AS INTEGER) AS odate_quarter, CAST(isodow(odate) - 1 AS INTEGER) AS odate_dayofweek
FROM ({NULLS_SQL}) d""",
)
def feat_generate(spark, sf_dir):
    d = orders_nulls(spark, sf_dir).select("o_orderkey", "price", "odate")
    out, _ = FE.generate_features(d, ["price"], ["odate"], order_by=ORDER)
    return out.withColumn("price_cumsum", F.round("price_cumsum", 2)).withColumn(
        "price_rolling_avg_3", F.round("price_rolling_avg_3", 4)
    )
