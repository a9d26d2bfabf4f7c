"""T01-T12 transformation workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as X
from . import register, table


@register(
    "xform_zscore",
    """
SELECT p_partkey,
       round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size,
       round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice
FROM part
""",
)
def xform_zscore(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    z = X.normalize_numeric(p, ["p_size", "p_retailprice"])
    return z.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register(
    "xform_one_hot",
    "SELECT p_partkey, p_brand, "
    + ", ".join(f"coalesce(p_type = '{t}', false) AS p_type_{t}" for t in _TYPES)
    + " FROM part",
)
def xform_one_hot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return X.one_hot_encode(p, ["p_type", "p_brand"], max_categories=10)


@register(
    "xform_parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders",
)
def xform_parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("d"),
    )
    return X.parse_dates(d, ["d"])


@register(
    "xform_convert_dtypes",
    """
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS a, o_totalprice AS b, o_orderpriority AS c,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS d
FROM orders
""",
)
def xform_convert_dtypes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("a"),
        F.col("o_totalprice").cast("string").alias("b"),
        F.col("o_orderpriority").alias("c"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey").cast("string")).alias("d"),
    )
    return X.convert_dtypes(t)


_DATE_FEATURES_SQL = """
SELECT o_orderkey, o_orderdate,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
       CAST(CASE WHEN isodow(o_orderdate) < 6 THEN 1 ELSE 0 END AS INTEGER) AS o_orderdate_weekday
FROM orders
"""


@register("xform_date_features", _DATE_FEATURES_SQL)
def xform_date_features(spark, sf_dir):
    return X.add_date_features(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register(
    "xform_aggregate",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
       round(quantile_cont(l_discount, 0.5), 6) AS l_discount, count(DISTINCT l_tax) AS l_tax, count(l_partkey) AS l_partkey,
       max(l_orderkey) AS l_orderkey, round(stddev_samp(l_extendedprice), 4) AS l_suppkey
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def xform_aggregate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.col("l_extendedprice"))
    a = X.aggregate(
        l,
        ["l_returnflag", "l_linestatus"],
        {
            "l_quantity": "sum",
            "l_extendedprice": "mean",
            "l_discount": "median",
            "l_tax": "nunique",
            "l_partkey": "count",
            "l_orderkey": "max",
            "l_suppkey": "std",
        },
    )
    return a.select(
        "l_returnflag", "l_linestatus",
        F.round("l_quantity", 4).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"),
        F.round("l_discount", 6).alias("l_discount"), "l_tax", "l_partkey", "l_orderkey",
        F.round("l_suppkey", 4).alias("l_suppkey"),
    )


@register(
    "xform_pivot",
    """
SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F",
       round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O",
       round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS "P"
FROM orders GROUP BY o_orderpriority
""",
)
def xform_pivot(spark, sf_dir):
    p = X.pivot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "mean")
    return p.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in p.columns if c != "o_orderpriority"])


@register(
    "xform_unpivot",
    """
SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey' AS variable, CAST(c_nationkey AS DOUBLE) AS value FROM customer
""",
)
def xform_unpivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return X.melt(c.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_custkey"])


@register(
    "xform_sort_limit",
    "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 10",
)
def xform_sort_limit(spark, sf_dir):
    return X.sort_values(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], ascending=False).limit(10)


@register(
    "xform_rank_average",
    """
SELECT l_orderkey, l_linenumber, l_quantity,
       rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS l_quantity_rank
FROM lineitem
""",
)
def xform_rank_average(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.rank_columns(l, ["l_quantity"])


def _bins_sql(col: str, n: int, labels: list[str] | None) -> str:
    """Bins by comparing each value with the edges, as a join over them."""
    if labels:
        label = "[" + ", ".join(f"'{l}'" for l in labels) + "][k + 1]"
    else:
        label = "printf('(%.3f, %.3f]', lo, hi)"
    return f"""
WITH s AS (SELECT CAST(min({col}) AS DOUBLE) AS a, CAST(max({col}) AS DOUBLE) AS b FROM part),
e AS (SELECT k, CASE WHEN k = 0 THEN a - (b - a) * 0.001 ELSE a + k * ((b - a) / {n}) END AS lo,
             CASE WHEN k = {n - 1} THEN b ELSE a + (k + 1) * ((b - a) / {n}) END AS hi FROM s, range({n}) t(k))
SELECT p_partkey, {col}, {label} AS {col}_binned, CAST(k + 1 AS INTEGER) AS bin_index, round(lo, 6) AS lower, round(hi, 6) AS upper
FROM part JOIN e ON {col} > lo AND {col} <= hi
"""


def _bins(spark, sf_dir, col, n, labels):
    p = table(spark, sf_dir, "part").select("p_partkey", col)
    b = X.create_bins(p, col, n, labels)
    return b.select(
        "p_partkey", col, f"{col}_binned", F.col(f"{col}_bin.bin_index").alias("bin_index"),
        F.round(f"{col}_bin.lower", 6).alias("lower"), F.round(f"{col}_bin.upper", 6).alias("upper"),
    )


@register("xform_bins", _bins_sql("p_retailprice", 5, None))
def xform_bins(spark, sf_dir):
    return _bins(spark, sf_dir, "p_retailprice", 5, None)


_SIZE_LABELS = ["XS", "S", "M", "L"]


@register("xform_bins_labeled", _bins_sql("p_size", 4, _SIZE_LABELS))
def xform_bins_labeled(spark, sf_dir):
    return _bins(spark, sf_dir, "p_size", 4, _SIZE_LABELS)


@register(
    "xform_declarative_chain",
    """
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust,
       round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS o_totalprice,
       o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
       CAST(CASE WHEN isodow(o_orderdate) < 6 THEN 1 ELSE 0 END AS INTEGER) AS o_orderdate_weekday
FROM orders
""",
)
def xform_declarative_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust"), "o_totalprice", "o_orderdate"
    )
    out = X.apply_transformations(
        o,
        [
            {"operation": "convert_dtypes"},
            {"operation": "normalize_numeric", "columns": ["o_totalprice"]},
            {"operation": "add_date_features", "date_column": "o_orderdate"},
        ],
    )
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))
