"""Null, NaN, tie and edge-value behaviour of the operators, on derived columns
of whole tables. The oracles state the rules by plain SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import transform as X
from ..operators.asof import asof_join
from ..operators.cleaning import column_modes
from ..operators.profile import correlation_long
from ..operators.quality import check_outliers_zscore
from ..operators.upsert import upsert_by_key
from ..plans import chartdata as K
from . import register, table
from .w_clean import NULLS_SQL, orders_nulls

#: Prices where every ninth is NaN and every seventh null; the SQL side has null
#: for both, since NaN counts as missing.
NAN_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v
FROM orders"""


def _nan(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 9 == 0, F.lit(float("nan"))).when(k % 7 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", v.alias("v"))


def _orders_in_groups(spark, sf_dir):
    return orders_nulls(spark, sf_dir).select("o_orderkey", "status", "price", "o_orderpriority")


_RUN = "ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register(
    "feat_running_total_null_group",
    f"""SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN round(sum(price) OVER (PARTITION BY status {_RUN}), 2) END AS price_running_total
FROM ({NULLS_SQL}) d""",
)
def feat_running_total_null_group(spark, sf_dir):
    r = FE.create_running_total(_orders_in_groups(spark, sf_dir), "price", ["o_orderkey"], "status", rows_per_bucket=1000)
    return r.select("o_orderkey", F.round("price_running_total", 2).alias("price_running_total"))


@register(
    "feat_lag_null_group",
    f"SELECT o_orderkey, lag(price, 3) OVER (PARTITION BY status ORDER BY o_orderkey) AS price_lag_3 FROM ({NULLS_SQL}) d",
)
def feat_lag_null_group(spark, sf_dir):
    r = FE.create_lag(_orders_in_groups(spark, sf_dir), "price", 3, ["o_orderkey"], "status", rows_per_bucket=1000)
    return r.select("o_orderkey", "price_lag_3")


@register(
    "feat_running_total_text_order",
    f"""SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN round(sum(price) OVER (ORDER BY status NULLS FIRST, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) END AS price_running_total FROM ({NULLS_SQL}) d""",
)
def feat_running_total_text_order(spark, sf_dir):
    """A text order key with nulls and few values: split on the second key."""
    r = FE.create_running_total(_orders_in_groups(spark, sf_dir), "price", ["status", "o_orderkey"], rows_per_bucket=1000)
    return r.select("o_orderkey", F.round("price_running_total", 2).alias("price_running_total"))


@register(
    "feat_running_nan",
    f"SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER ({_RUN}), 2) END AS v_running_total FROM ({NAN_SQL}) d",
)
def feat_running_nan(spark, sf_dir):
    r = FE.create_running_total(_nan(spark, sf_dir), "v", ["o_orderkey"])
    return r.select("o_orderkey", F.round("v_running_total", 2).alias("v_running_total"))


@register(
    "xform_median_many_groups",
    "SELECT l_orderkey, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice FROM lineitem GROUP BY l_orderkey",
)
def xform_median_many_groups(spark, sf_dir):
    """A median for every order: the groups never leave the executors."""
    a = X.aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"l_extendedprice": "median"})
    return a.select("l_orderkey", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@register(
    "xform_zscore_nan",
    f"SELECT o_orderkey, round((v - (SELECT avg(v) FROM ({NAN_SQL}) a)) / (SELECT stddev_samp(v) FROM ({NAN_SQL}) b), 6) AS v FROM ({NAN_SQL}) d",
)
def xform_zscore_nan(spark, sf_dir):
    return X.normalize_numeric(_nan(spark, sf_dir), ["v"]).select("o_orderkey", F.round("v", 6).alias("v"))


@register(
    "xform_aggregate_nan",
    f"SELECT o_orderstatus, count(v) AS n, round(avg(v), 4) AS v FROM ({NAN_SQL}) d GROUP BY o_orderstatus",
)
def xform_aggregate_nan(spark, sf_dir):
    d = _nan(spark, sf_dir).withColumn("n", F.col("v"))
    return X.aggregate(d, ["o_orderstatus"], {"n": "count", "v": "mean"}).select("o_orderstatus", "n", F.round("v", 4).alias("v"))


@register(
    "xform_rank_wide_integers",
    """SELECT o_orderkey, CAST(9007199254740992 AS BIGINT) + o_custkey AS big,
rank() OVER (ORDER BY o_custkey DESC) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS big_rank FROM orders""",
)
def xform_rank_wide_integers(spark, sf_dir):
    """Integers beyond 2^53, which are equal as doubles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(2**53) + F.col("o_custkey")).alias("big"))
    return X.rank_columns(o, ["big"])


@register(
    "xform_bins_on_edges",
    """
WITH s AS (SELECT o_orderkey, 2.5 + (o_orderkey % 101) * 0.038 AS x FROM (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders) o),
m AS (SELECT min(x) AS a, max(x) AS b FROM s),
e AS (SELECT k, CASE WHEN k = 0 THEN a - (b - a) * 0.001 ELSE a + k * ((b - a) / 10) END AS lo,
             CASE WHEN k = 9 THEN b ELSE a + (k + 1) * ((b - a) / 10) END AS hi FROM m, range(10) t(k))
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(k + 1 AS INTEGER) AS bin_index FROM s JOIN e ON x > lo AND x <= hi""",
)
def xform_bins_on_edges(spark, sf_dir):
    """Values that lie on the edges of their bins."""
    x = F.lit(2.5) + (F.col("o_orderkey") % 101).cast("double") * F.lit(0.038)
    o = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    return X.create_bins(o, "x", 10).select("o_orderkey", F.col("x_bin.bin_index").alias("bin_index"))


@register(
    "xform_bins_nan",
    f"""
WITH m AS (SELECT min(v) AS a, max(v) AS b FROM ({NAN_SQL}) d),
e AS (SELECT k, CASE WHEN k = 0 THEN a - (b - a) * 0.001 ELSE a + k * ((b - a) / 4) END AS lo,
             CASE WHEN k = 3 THEN b ELSE a + (k + 1) * ((b - a) / 4) END AS hi FROM m, range(4) t(k))
SELECT o_orderkey, CAST(k + 1 AS INTEGER) AS bin_index FROM ({NAN_SQL}) d LEFT JOIN e ON v > lo AND v <= hi""",
)
def xform_bins_nan(spark, sf_dir):
    return X.create_bins(_nan(spark, sf_dir), "v", 4).select("o_orderkey", F.col("v_bin.bin_index").alias("bin_index"))


_PIVOT_SQL = """SELECT o_orderkey % 40 AS k, o_orderstatus AS s,
CASE WHEN (o_orderkey % 40) % 4 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders"""


def _pivot_input(spark, sf_dir):
    k = F.col("o_orderkey") % 40
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("v"))


@register(
    "xform_pivot_missing_cells",
    f"""SELECT k, round(max(v) FILTER (WHERE s = 'F'), 4) AS "F", round(max(v) FILTER (WHERE s = 'O'), 4) AS "O", round(max(v) FILTER (WHERE s = 'P'), 4) AS "P"
FROM ({_PIVOT_SQL}) d WHERE v IS NOT NULL GROUP BY k""",
)
def xform_pivot_missing_cells(spark, sf_dir):
    """Rows whose cells are all missing are dropped."""
    p = X.pivot(_pivot_input(spark, sf_dir), "k", "s", "v", "max")
    return p.select("k", *[F.round(c, 4).alias(c) for c in p.columns if c != "k"])


@register(
    "xform_pivot_sum_cells",
    f"SELECT k, s AS \"column\", round(coalesce(sum(v), 0), 4) AS value FROM ({_PIVOT_SQL}) d GROUP BY k, s",
)
def xform_pivot_sum_cells(spark, sf_dir):
    """Long form; a sum over missing values is 0."""
    return X.pivot_long(_pivot_input(spark, sf_dir), "k", "s", "v", "sum").withColumn("value", F.round("value", 4))


@register(
    "clean_mode_numeric_ties",
    """SELECT min(m) AS mode_value FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 10 END AS m, count(*) AS n
FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0) AND o_orderkey > 0 GROUP BY 1) t
WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM orders
           WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0) AND o_orderkey > 0 GROUP BY o_orderkey % 2) u)""",
)
def clean_mode_numeric_ties(spark, sf_dir):
    """Equal counts of 9 and 10: the smaller number, not the smaller text."""
    o = table(spark, sf_dir, "orders").where("o_orderkey > 0")
    even = o.where("o_orderkey % 2 = 0").agg(F.max("o_orderkey").alias("top"))
    d = o.join(F.broadcast(even), F.col("o_orderkey") <= F.col("top")).select(F.when(F.col("o_orderkey") % 2 == 0, 9).otherwise(10).alias("m"))
    return spark.createDataFrame([(column_modes(d, ["m"])["m"],)], "mode_value int")


@register(
    "val_outliers_nan",
    f"""
WITH s AS (SELECT avg(v) AS m, stddev_samp(v) AS d, count(*) AS n FROM ({NAN_SQL}) a)
SELECT 'v' AS "column", count(*) AS count, round(count(*) / max(n) * 100, 2) AS percentage FROM ({NAN_SQL}) b, s
WHERE abs(v - m) / d > 1.5 HAVING count(*) > 0""",
)
def val_outliers_nan(spark, sf_dir):
    return check_outliers_zscore(_nan(spark, sf_dir), 1.5, ["v"])


@register(
    "kpi_cards_nan",
    f"SELECT 'v' AS metric, round(sum(v), 2) AS sum, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max FROM ({NAN_SQL}) d",
)
def kpi_cards_nan(spark, sf_dir):
    k = K.kpi_cards(_nan(spark, sf_dir), ["v"], ["o_orderkey"])
    return k.select("metric", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "min", "max")


@register(
    "chart_histogram_nan",
    f"""SELECT CAST(least(19, floor((v - a) / w)) AS INTEGER) AS bin, count(*) AS count
FROM ({NAN_SQL}) d, (SELECT min(v) AS a, (max(v) - min(v)) / 20 AS w FROM ({NAN_SQL}) e) s WHERE v IS NOT NULL GROUP BY 1""",
)
def chart_histogram_nan(spark, sf_dir):
    return K.histogram(_nan(spark, sf_dir), "v").select("bin", "count")


@register("prof_corr_nan", f"SELECT round(corr(v, o_custkey), 6) AS corr FROM ({NAN_SQL}) d")
def prof_corr_nan(spark, sf_dir):
    c = correlation_long(_nan(spark, sf_dir), columns=["v", "o_custkey"])
    return c.where("col1 = 'v' AND col2 = 'o_custkey'").select(F.round("corr", 6).alias("corr"))


_ASOF_SQL = """
l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 20 END AS k,
             CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey END AS t FROM orders),
r AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 20 END AS k,
             CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 8 END AS t, c_custkey AS rid FROM customer)"""


@register(
    "sql_join_asof_nulls",
    f"""WITH {_ASOF_SQL},
m AS (SELECT l.o_orderkey, arg_max(r.rid, r.t) AS rid FROM l JOIN r ON l.k = r.k AND r.t <= l.t GROUP BY l.o_orderkey)
SELECT l.o_orderkey, m.rid FROM l LEFT JOIN m ON l.o_orderkey = m.o_orderkey""",
)
def sql_join_asof_nulls(spark, sf_dir):
    """Null keys and null times, on either side, match nothing."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    left = table(spark, sf_dir, "orders").select(o, F.when(o % 5 != 0, F.col("o_custkey") % 20).alias("k"), F.when(o % 6 != 0, o).alias("t"))
    right = table(spark, sf_dir, "customer").select(F.when(c % 4 != 0, c % 20).alias("k"), F.when(c % 3 != 0, c * 8).alias("rt"), c.alias("rid"))
    return asof_join(left, right, ["k"], "t", "rt", ["rid"], rows_per_bucket=2000).select("o_orderkey", "rid")


@register(
    "table_upsert_null_and_repeated_keys",
    """
WITH base AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN NULL ELSE c_name END AS name, c_acctbal AS payload FROM customer),
ch AS (SELECT name, max(payload) AS payload FROM (
         SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey || '-nation' END AS name, s_acctbal AS payload FROM supplier) s GROUP BY name),
new AS (SELECT name, payload, row_number() OVER (ORDER BY name) AS k FROM ch WHERE name IS NOT NULL)
SELECT id, name, CASE WHEN name IS NULL THEN (SELECT payload FROM ch WHERE name IS NULL) ELSE payload END AS payload FROM base
UNION ALL SELECT (SELECT max(id) FROM base) + k, name, payload FROM new""",
)
def table_upsert_null_and_repeated_keys(spark, sf_dir):
    """A null key is a key; of several changes with one key the greatest counts."""
    c = table(spark, sf_dir, "customer")
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    base = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") != 1, F.col("c_name")).alias("name"),
        F.col("c_acctbal").alias("payload"), t0.alias("created_at"), t0.alias("updated_at"),
    )
    name = F.when(F.col("s_suppkey") % 10 != 0, F.concat(F.col("s_nationkey").cast("string"), F.lit("-nation")))
    changes = table(spark, sf_dir, "supplier").select(name.alias("name"), F.col("s_acctbal").alias("payload"))
    return upsert_by_key(base, changes, now=dt.datetime(2024, 6, 1)).select("id", "name", "payload")
