"""V01-V06 validation workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as V
from . import register, table
from .w_clean import NULLS_SQL, SKEW_SQL, orders_nulls, orders_skewed

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DUPS_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'"
NULL_COLS = ["o_orderkey", "o_custkey", "price", "status", "odate", "o_orderpriority"]


def _dups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.unionByName(o.where(F.col("o_orderstatus") == "F"))


@register(
    "val_duplicates",
    f"""
WITH g AS (SELECT count(*) AS n FROM ({DUPS_SQL}) d GROUP BY {", ".join(ORDER_COLS)})
SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) > 0 AS has_duplicates,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_count,
       CASE WHEN sum(n) > 0 THEN round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n) * 100, 2) ELSE 0 END AS duplicate_percentage
FROM g
""",
)
def val_duplicates(spark, sf_dir):
    return V.check_duplicates(_dups(spark, sf_dir))


def _missing_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count FROM ({src}) d" for c in cols]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") m WHERE missing_count > 0"


@register("val_missing", _missing_sql(NULLS_SQL, NULL_COLS))
def val_missing(spark, sf_dir):
    _, per = V.check_missing_values(orders_nulls(spark, sf_dir))
    return per


def _z_sql(src: str, cols: list[str], thr: float = 3.0) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE abs(({c} - m) / s) > {thr}) AS BIGINT) AS count, "
            f"(SELECT count(*) FROM ({src}) t) AS n FROM ({src}) d, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ({src}) e) st"
        )
    return (
        "SELECT \"column\", count, round(count / n * 100, 2) AS percentage FROM ("
        + " UNION ALL ".join(parts)
        + ") z WHERE count > 0"
    )


@register("val_outliers_zscore", _z_sql(SKEW_SQL, ["o_orderkey", "x", "z"]))
def val_outliers_zscore(spark, sf_dir):
    return V.check_outliers_zscore(orders_skewed(spark, sf_dir))


_EXPECTED = {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)", "o_comment": "string", "o_orderdate": "timestamp_ntz"}


def _schema_sql() -> str:
    vals = ", ".join(f"('{c}', '{t}')" for c, t in _EXPECTED.items())
    return f"""
WITH e(col, want) AS (VALUES {vals}),
d AS (SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
             WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS t FROM (DESCRIBE orders))
SELECT e.col AS "column", CASE WHEN d.t IS NULL THEN 'missing' ELSE 'expected ' || e.want || ', got ' || d.t END AS issue
FROM e LEFT JOIN d ON d.column_name = e.col WHERE d.t IS NULL OR d.t <> e.want
"""


@register("val_schema_compliance", _schema_sql())
def val_schema_compliance(spark, sf_dir):
    """Issues against an expected schema with one missing and one mistyped column."""
    return V.check_schema_compliance(table(spark, sf_dir, "orders"), _EXPECTED)


_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "price": "double", "status": "string", "odate": "timestamp_ntz", "o_orderpriority": "string"}


def _dataset_sql() -> str:
    src = NULLS_SQL
    dtype_rows = " UNION ALL ".join(
        f"SELECT 'dtype', '{c}', 'dtype', CAST(NULL AS DOUBLE), '{t}'" for c, t in _TYPES.items()
    )
    z = _z_sql(src, ["o_orderkey", "o_custkey", "price"])
    miss = _missing_sql(src, NULL_COLS)
    return f"""
WITH g AS (SELECT count(*) AS n FROM ({src}) d GROUP BY {", ".join(NULL_COLS)}),
dup AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS DOUBLE) AS c, sum(n) AS t FROM g),
miss AS ({miss}), z AS ({z})
SELECT 'shape' AS "check", CAST(NULL AS VARCHAR) AS "column", 'row_count' AS metric, CAST((SELECT count(*) FROM ({src}) d) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text
UNION ALL SELECT 'shape', NULL, 'column_count', 6.0, NULL
UNION ALL {dtype_rows}
UNION ALL SELECT 'duplicates', NULL, 'duplicate_count', c, NULL FROM dup
UNION ALL SELECT 'duplicates', NULL, 'duplicate_percentage', CASE WHEN t > 0 THEN round(c / t * 100, 2) ELSE 0 END, NULL FROM dup
UNION ALL SELECT 'missing', NULL, 'total_missing', CAST((SELECT sum(missing_count) FROM miss) AS DOUBLE), NULL
UNION ALL SELECT 'missing', "column", 'missing_count', CAST(missing_count AS DOUBLE), NULL FROM miss
UNION ALL SELECT 'outliers', "column", 'count', CAST(count AS DOUBLE), NULL FROM z
UNION ALL SELECT 'outliers', "column", 'percentage', percentage, NULL FROM z
"""


@register("val_dataset", _dataset_sql())
def val_dataset(spark, sf_dir):
    return V.validate_dataset(orders_nulls(spark, sf_dir))


def _anom_sql() -> str:
    parts = []
    for c in ["x", "z"]:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS BIGINT) AS anomaly_count, "
            f"round(any_value(q1 - 3 * (q3 - q1)), 6) AS lower_bound, round(any_value(q3 + 3 * (q3 - q1)), 6) AS upper_bound "
            f"FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d) q"
        )
    return f"WITH d AS ({SKEW_SQL}) SELECT * FROM (" + " UNION ALL ".join(parts) + ") a WHERE anomaly_count > 0"


@register("val_anomalies_iqr3", _anom_sql())
def val_anomalies_iqr3(spark, sf_dir):
    s, _ = V.detect_anomalies(orders_skewed(spark, sf_dir), ["x", "z"])
    return s.select("column", "anomaly_count", F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"))


def _anom_rows_sql() -> str:
    parts = []
    for c in ["x", "z"]:
        parts.append(
            f"(SELECT '{c}' AS \"column\", o_orderkey FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d) q "
            f"WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) ORDER BY o_orderkey LIMIT 10)"
        )
    return f"WITH d AS ({SKEW_SQL}) " + " UNION ALL ".join(parts)


@register("val_anomaly_rows", _anom_rows_sql())
def val_anomaly_rows(spark, sf_dir):
    _, rows = V.detect_anomalies(orders_skewed(spark, sf_dir), ["x", "z"], order_by=["o_orderkey"])
    return rows
