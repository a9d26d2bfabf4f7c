"""P01-P10 profiling workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from . import register, table
from .w_clean import NULLS_SQL, orders_nulls
from .w_quality import DUPS_SQL, NULL_COLS, _dups

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# lineitem measures plus one derived column with nulls
LI_SQL = """
SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice * l_discount END AS disc_amt
FROM lineitem
"""
LI_COLS = LI_NUM + ["disc_amt"]


def _li(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        "l_returnflag", "l_linestatus", *LI_NUM,
        F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice") * F.col("l_discount")).alias("disc_amt"),
    )


def _r6(df, cols):
    # means of 2-decimal data are exact short decimals: 8 places keeps them off a rounding tie
    return df.select(*[F.round(c, 8 if c == "mean" else 6).alias(c) if c in cols else F.col(c) for c in df.columns])


_PCTS = [("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)]
_DESC_DBL = ["count", "mean", "std", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "max", "skewness", "kurtosis", "missing_pct"]


def _desc_sql() -> str:
    parts = []
    for c in LI_COLS:
        pcts = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for n, p in _PCTS)
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(min({c}), 6) AS min, {pcts}, round(max({c}), 6) AS max, round(skewness({c}), 6) AS skewness, "
            f"round(kurtosis({c}), 6) AS kurtosis, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
            f"round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM d"
        )
    return f"WITH d AS ({LI_SQL}) " + " UNION ALL ".join(parts)


@register("prof_descriptive_stats", _desc_sql())
def prof_descriptive_stats(spark, sf_dir):
    return _r6(P.descriptive_stats(_li(spark, sf_dir), LI_COLS), _DESC_DBL)


def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            v = "max(1.0)" if a == b else f"round(corr({a}, {b}), 6)"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {v} AS corr FROM ({src}) d")
    return " UNION ALL ".join(parts)


@register("prof_corr_pearson", _corr_sql(LI_SQL, LI_COLS))
def prof_corr_pearson(spark, sf_dir):
    return _r6(P.correlation_long(_li(spark, sf_dir), columns=LI_COLS), ["corr"])


def _pair_ranks_sql(columns: dict[str, str], source: str) -> str:
    """Each pair of columns over the rows that have both, ranked there."""
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    names = list(columns)
    parts = [f"SELECT '{c}' AS col1, '{c}' AS col2, 1.0::DOUBLE AS corr" for c in names]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for x, y in ((a, b), (b, a)):
                parts.append(
                    f"SELECT '{x}', '{y}', round(corr(ra, rb), 6) FROM (SELECT {rank.format('a')} AS ra, {rank.format('b')} AS rb "
                    f"FROM (SELECT {columns[a]} AS a, {columns[b]} AS b FROM ({source}) s) v WHERE a IS NOT NULL AND b IS NOT NULL) r"
                )
    return " UNION ALL ".join(parts)


@register("prof_corr_spearman", _pair_ranks_sql({c: c for c in LI_COLS}, LI_SQL))
def prof_corr_spearman(spark, sf_dir):
    return _r6(P.correlation_long(_li(spark, sf_dir), method="spearman", columns=LI_COLS), ["corr"])


NULLABLE_COLS = ["quantity", "price", "discount", "line", "key"]
NULLABLE = {
    "quantity": "CASE WHEN l_linenumber <> 2 THEN l_quantity END",
    "price": "CASE WHEN l_quantity > 10 THEN l_extendedprice END",
    "discount": "CASE WHEN l_returnflag <> 'R' THEN l_discount END",
    "line": "l_linenumber",
    "key": "CASE WHEN l_linestatus = 'O' OR l_tax > 0.02 THEN l_orderkey END",
}


@register("prof_corr_spearman_nulls", _pair_ranks_sql(NULLABLE, "SELECT * FROM lineitem"))
def prof_corr_spearman_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in NULLABLE.items()])
    return _r6(P.correlation_long(rows, method="spearman", columns=NULLABLE_COLS), ["corr"])


VC_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]
_VC_TYPES = {"o_orderstatus": "string", "o_orderpriority": "string", "o_custkey": "bigint"}


def _vc_sql(cols, top) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", '{_VC_TYPES[c]}' AS dtype, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols
    ]
    return f"""
WITH c AS ({" UNION ALL ".join(parts)}),
u AS (SELECT "column", count(*) AS "unique" FROM c GROUP BY "column")
SELECT "column", dtype, "unique", value, count, rank FROM (
  SELECT c.*, u."unique", CAST(row_number() OVER (PARTITION BY c."column" ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM c JOIN u USING ("column")) t WHERE rank <= {top}
"""


@register("prof_value_counts", _vc_sql(VC_COLS, 10))
def prof_value_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*VC_COLS)
    info, top = P.value_counts(o, top_n=10)
    return top.join(info, "column").select("column", "dtype", "unique", "value", "count", "rank")


@register(
    "prof_missing_patterns",
    f"""
WITH m AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count, count(*) AS n FROM ({NULLS_SQL}) d" for c in NULL_COLS)})
SELECT "column", missing_count, round(missing_count / n * 100, 2) AS missing_pct FROM m WHERE missing_count > 0
""",
)
def prof_missing_patterns(spark, sf_dir):
    return P.missing_patterns(orders_nulls(spark, sf_dir))


@register(
    "prof_overview",
    f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DUPS_SQL}) x) y) AS BIGINT) AS duplicate_rows,
       round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DUPS_SQL}) x) y)) / count(*) * 100, 2) AS duplicate_pct
FROM ({DUPS_SQL}) d
""",
)
def prof_overview(spark, sf_dir):
    return P.overview(_dups(spark, sf_dir))


_NULL_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "price": "double", "status": "string", "odate": "timestamp_ntz", "o_orderpriority": "string"}
_NUMS = {"o_orderkey", "o_custkey", "price"}


def _infer_sql() -> str:
    parts = []
    for i, c in enumerate(NULL_COLS):
        mn = f"CAST(min({c}) AS DOUBLE)" if c in _NUMS else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if c in _NUMS else "CAST(NULL AS DOUBLE)"
        txt = f"CAST({c} AS VARCHAR)" if _NULL_TYPES[c] != "timestamp_ntz" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{_NULL_TYPES[c]}' AS dtype, count(*) > count({c}) AS nullable, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"coalesce(list({txt} ORDER BY o_orderkey) FILTER (WHERE {c} IS NOT NULL)[1:3], []) AS sample_values, {mn} AS min, {mx} AS max FROM d"
        )
    return f"WITH d AS ({NULLS_SQL}) " + " UNION ALL ".join(parts)


@register("prof_infer_schema", _infer_sql())
def prof_infer_schema(spark, sf_dir):
    return P.infer_schema(orders_nulls(spark, sf_dir), order_by=["o_orderkey"])


def _summ_sql() -> str:
    parts = []
    for c in ["o_totalprice", "o_custkey"]:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, "
            f"round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
            f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM orders"
        )
    for c in ["o_orderstatus", "o_orderpriority"]:
        parts.append(
            f"SELECT '{c}', (SELECT count({c}) FROM orders), (SELECT count(DISTINCT {c}) FROM orders), v, n, "
            f"NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY n DESC, v LIMIT 1) t"
        )
    return " UNION ALL ".join(parts)


@register("prof_summarize_all", _summ_sql())
def prof_summarize_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    return _r6(P.summarize_all(o), ["mean", "std", "min", "p25", "p50", "p75", "max"])


def _notable_sql() -> str:
    parts = []
    for i, a in enumerate(LI_COLS):
        for j, b in enumerate(LI_COLS):
            if i < j:
                parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {i} AS i1, {j} AS i2, corr({a}, {b}) AS corr FROM d")
    return (
        f"WITH d AS ({LI_SQL}), p AS ({' UNION ALL '.join(parts)}) "
        "SELECT col1, col2, round(corr, 6) AS corr FROM p WHERE abs(corr) > 0.3 ORDER BY abs(corr) DESC, i1, i2 LIMIT 10"
    )


@register("prof_notable_correlations", _notable_sql())
def prof_notable_correlations(spark, sf_dir):
    d = _li(spark, sf_dir).select(*LI_COLS)
    return _r6(P.notable_correlations(d), ["corr"])


def _group_sql() -> str:
    parts = [
        f"SELECT l_returnflag AS \"group\", '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(coalesce(sum({c}), 0), 2) AS sum, "
        f"count({c}) AS count FROM d WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"
        for c in LI_NUM
    ]
    return f"WITH d AS ({LI_SQL}) " + " UNION ALL ".join(parts)


@register("prof_group_summary", _group_sql())
def prof_group_summary(spark, sf_dir):
    return P.group_summary(_li(spark, sf_dir))


def _numctx_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", round(avg({c}), 8) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(min({c}), 6) AS min, "
        f"round(max({c}), 6) AS max, round(stddev_samp({c}), 6) AS std, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM d"
        for c in LI_COLS
    ]
    return f"WITH d AS ({LI_SQL}) " + " UNION ALL ".join(parts)


@register("prof_numeric_context", _numctx_sql())
def prof_numeric_context(spark, sf_dir):
    return _r6(P.numeric_context(_li(spark, sf_dir)), ["mean", "median", "min", "max", "std"])


def _catctx_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ["o_orderstatus", "o_orderpriority"]
    ]
    return f"""
WITH c AS ({" UNION ALL ".join(parts)}), u AS (SELECT "column", count(*) AS "unique" FROM c GROUP BY "column")
SELECT "column", "unique", value, count, rank FROM (
  SELECT c.*, u."unique", CAST(row_number() OVER (PARTITION BY c."column" ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM c JOIN u USING ("column")) t WHERE rank <= 8
"""


@register("prof_categorical_context", _catctx_sql())
def prof_categorical_context(spark, sf_dir):
    return P.categorical_context(table(spark, sf_dir, "orders"))


_KENDALL_COLS = ["o_totalprice", "o_custkey", "o_orderkey"]


def _kendall_sql() -> str:
    parts = []
    for a in _KENDALL_COLS:
        for b in _KENDALL_COLS:
            if a == b:
                parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0 AS corr")
                continue
            parts.append(
                f"""SELECT '{a}' AS col1, '{b}' AS col2, round((2 * nc - (n * (n - 1) / 2 - n1 - n2 + n3))
       / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 9) AS corr
FROM (SELECT sum(w) AS n, sum(w * (w - 1) / 2) AS n3 FROM p_{a}_{b}) t,
     (SELECT sum(c * (c - 1) / 2) AS n1 FROM (SELECT sum(w) AS c FROM p_{a}_{b} GROUP BY x) u) tx,
     (SELECT sum(c * (c - 1) / 2) AS n2 FROM (SELECT sum(w) AS c FROM p_{a}_{b} GROUP BY y) v) ty,
     (SELECT sum(l.w * r.w) AS nc FROM p_{a}_{b} l JOIN p_{a}_{b} r ON l.x < r.x AND l.y < r.y) cc"""
            )
    ctes = ", ".join(
        f"p_{a}_{b} AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS w FROM orders GROUP BY 1, 2)"
        for a in _KENDALL_COLS
        for b in _KENDALL_COLS
        if a != b
    )
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


@register("prof_corr_kendall", _kendall_sql())
def prof_corr_kendall(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*_KENDALL_COLS)
    return _r9(P.correlation_long(o, "kendall"))


def _r9(df):
    return df.withColumn("corr", F.round("corr", 9))
