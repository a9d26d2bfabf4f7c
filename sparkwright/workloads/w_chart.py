"""K01-K30 chart-dataset and dashboard workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import chartdata as K
from ..plans import dashboards as D
from . import register, table
from .w_clean import NULLS_SQL, SKEW_SQL, orders_nulls, orders_skewed

# ----------------------------------------------------------------- SQL helpers (oracle side)


def s_sum_by(src: str, keys: list[str], measures: list[str], head: int | None = None, rnd: int = 4) -> str:
    k = ", ".join(keys)
    ms = ", ".join(f"round(CAST(coalesce(sum({m}), 0) AS DOUBLE), {rnd}) AS {m}" for m in measures)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    lim = f" ORDER BY {k} LIMIT {head}" if head else ""
    return f"SELECT {k}, {ms} FROM ({src}) s WHERE {nn} GROUP BY {k}{lim}"


def s_hist(src: str, col: str, bins: int = 20) -> str:
    return f"""SELECT CAST(bin AS INTEGER) AS bin, round(a + bin * w, 6) AS lower, round(a + (bin + 1) * w, 6) AS upper, count FROM (
  SELECT least({bins - 1}, floor((CAST({col} AS DOUBLE) - a) / w)) AS bin, any_value(a) AS a, any_value(w) AS w, count(*) AS count
  FROM ({src}) s, (SELECT CAST(min({col}) AS DOUBLE) AS a, CASE WHEN max({col}) > min({col}) THEN (max({col}) - min({col})) / {bins} ELSE 1.0 END AS w FROM ({src}) t) e
  WHERE {col} IS NOT NULL GROUP BY 1) h"""


def s_long(chart: str, sql: str, x: str, ys: list[str], series: str | None = None) -> str:
    # running sums are exact at 2 decimals for 2-decimal inputs; other values at 4
    if "cumulative" in chart:
        return " UNION ALL ".join(
            f"SELECT '{chart}' AS chart, '{y}' AS series, CAST({x} AS VARCHAR) AS x, round(CAST({y} AS DOUBLE), 2) AS y, CAST(NULL AS VARCHAR) AS text FROM ({sql}) p" for y in ys
        )
    if series:
        return f"SELECT '{chart}' AS chart, CAST({series} AS VARCHAR) AS series, CAST({x} AS VARCHAR) AS x, round(CAST({ys[0]} AS DOUBLE), 4) AS y, CAST(NULL AS VARCHAR) AS text FROM ({sql}) p"
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, '{y}' AS series, CAST({x} AS VARCHAR) AS x, round(CAST({y} AS DOUBLE), 4) AS y, CAST(NULL AS VARCHAR) AS text FROM ({sql}) p" for y in ys
    )


def s_kpi(src: str, metrics: list[str], order: str) -> str:
    order = f"row({order})" if "," in order else order
    parts = []
    for m in metrics:
        parts.append(
            f"SELECT '{m}' AS metric, '{m.replace('_', ' ').title()}' AS title, CAST(sum({m}) AS DOUBLE) AS sum, avg({m}) AS mean, "
            f"CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, "
            f"CASE WHEN arg_max_null({m}, {order}) > arg_min_null({m}, {order}) THEN 'up' WHEN count(*) > 1 THEN 'down' ELSE 'neutral' END AS trend, "
            f"CASE WHEN typeof(any_value({m})) IN ('DOUBLE', 'FLOAT') THEN format('{{:,.2f}}', CAST(sum({m}) AS DOUBLE)) ELSE format('{{:,}}', CAST(sum({m}) AS BIGINT)) END AS value_text, "
            f"format('{{:,.2f}}', avg({m})) AS mean_text, format('{{:,.2f}}', CAST(min({m}) AS DOUBLE)) AS min_text, format('{{:,.2f}}', CAST(max({m}) AS DOUBLE)) AS max_text "
            f"FROM ({src}) s"
        )
    return " UNION ALL ".join(parts)


def s_cumulative(src: str, date: str, m: str) -> str:
    return (
        f"SELECT {date}, {m}, round(sum({m}) OVER (ORDER BY {date} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS {m}_cumulative "
        f"FROM ({s_sum_by(src, [date], [m], rnd=12)}) t"
    )


def r4(df, cols):
    return df.select(*[F.round(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


def long4(df):
    return df.withColumn("y", F.when(F.col("chart").contains("cumulative"), F.round("y", 2)).otherwise(F.round("y", 4)))


# ----------------------------------------------------------------- frames

ORD_SQL = "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders"
LI_SQL = "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey FROM lineitem"


def _ord(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


def _li(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")


# ----------------------------------------------------------------- K01-K03


@register(
    "kpi_cards",
    "SELECT metric, title, round(sum, 4) AS sum, round(mean, 6) AS mean, min, max, trend, value_text, mean_text, min_text, max_text FROM ("
    + s_kpi(ORD_SQL, ["o_totalprice", "o_custkey"], "o_orderkey")
    + ") k",
)
def kpi_cards(spark, sf_dir):
    k = K.kpi_cards(_ord(spark, sf_dir), ["o_totalprice", "o_custkey"], order_by=["o_orderkey"])
    return k.select("metric", "title", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "min", "max", "trend", "value_text", "mean_text", "min_text", "max_text")


_TEMPLATES = [
    "show the trend of", "compare the", "distribution of", "composition of", "correlation between",
    "relationship among", "heatmap for", "growth in", "ranking by", "partofwhole view", "tell me about", "Show TREND and compare",
]


def _question_sql() -> str:
    arr = "[" + ", ".join(f"'{t}'" for t in _TEMPLATES) + "]"
    return f"{arr}[turn % {len(_TEMPLATES)} + 1] || ' ' || text"


def _question_col():
    arr = F.array(*[F.lit(t) for t in _TEMPLATES])
    return F.concat(F.element_at(arr, (F.col("turn") % len(_TEMPLATES) + 1).cast("int")), F.lit(" "), F.col("text"))


@register(
    "chart_type_from_question",
    "SELECT conv_id, turn, CASE WHEN q ILIKE '%trend%' THEN 'line' WHEN q ILIKE '%compare%' THEN 'bar' WHEN q ILIKE '%distribution%' THEN 'histogram' "
    "WHEN q ILIKE '%composition%' THEN 'pie' WHEN q ILIKE '%correlation%' OR q ILIKE '%relationship%' THEN 'scatter' WHEN q ILIKE '%heatmap%' THEN 'heatmap' "
    "WHEN q ILIKE '%growth%' THEN 'line' WHEN q ILIKE '%ranking%' THEN 'bar' WHEN q ILIKE '%partofwhole%' THEN 'pie'"
    + f" END AS chart_type FROM (SELECT conv_id, turn, {_question_sql()} AS q FROM conversations) t",
)
def chart_type_from_question(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", K.chart_type_for_intent(_question_col()).alias("chart_type"))


@register("chart_auto", s_sum_by("SELECT p_brand, p_retailprice FROM part", ["p_brand"], ["p_retailprice"], head=20))
def chart_auto(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"))
    assert kind == "bar", kind
    return r4(data, ["p_retailprice"])


# ----------------------------------------------------------------- K04-K06

_QDUP_SQL = f"SELECT * FROM ({NULLS_SQL}) a UNION ALL SELECT * FROM ({NULLS_SQL}) b WHERE status = 'F'"


def _qdup(spark, sf_dir):
    n = orders_nulls(spark, sf_dir)
    return n.unionByName(n.where(F.col("status") == "F"))


_NULL_COLS = ["o_orderkey", "o_custkey", "price", "status", "odate", "o_orderpriority"]


def _gauge_sql() -> str:
    miss = " + ".join(f"(count(*) - count({c}))" for c in _NULL_COLS)
    return f"""
WITH s AS (SELECT count(*) AS n, {miss} AS m FROM ({_QDUP_SQL}) d),
u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM ({_QDUP_SQL}) x) y),
v AS (SELECT round((n * 6 - m) / (n * 6) * 100, 1) AS comp, 100.0 - round((n - d) / n * 100, 1) AS uniq FROM s, u)
SELECT 'completeness' AS gauge, comp AS value, CASE WHEN comp < 30 THEN 'low' WHEN comp < 70 THEN 'mid' ELSE 'high' END AS zone FROM v
UNION ALL SELECT 'uniqueness', uniq, CASE WHEN uniq < 30 THEN 'low' WHEN uniq < 70 THEN 'mid' ELSE 'high' END FROM v
"""


@register("chart_quality_gauges", _gauge_sql())
def chart_quality_gauges(spark, sf_dir):
    return K.quality_gauges(_qdup(spark, sf_dir))


def _missing_cols_sql(src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count FROM ({src}) d" for c in _NULL_COLS)


@register(
    "chart_missing_bar",
    f'SELECT * FROM ({_missing_cols_sql(NULLS_SQL)}) m WHERE missing_count > 0 ORDER BY missing_count DESC, "column" LIMIT 15',
)
def chart_missing_bar(spark, sf_dir):
    return K.missing_bar(orders_nulls(spark, sf_dir))


@register(
    "chart_missing_pattern",
    "WITH h AS (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS r FROM ("
    + NULLS_SQL
    + ") d ORDER BY o_orderkey LIMIT 50) "
    + " UNION ALL ".join(f"SELECT r AS row, '{c}' AS \"column\", CAST({c} IS NULL AS INTEGER) AS missing FROM h" for c in _NULL_COLS),
)
def chart_missing_pattern(spark, sf_dir):
    return K.missing_pattern(orders_nulls(spark, sf_dir), ["o_orderkey"])


# ----------------------------------------------------------------- K07-K09


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("chart_histogram", s_hist(LI_SQL, "l_extendedprice"))
def chart_histogram(spark, sf_dir):
    return _r6(K.histogram(_li(spark, sf_dir), "l_extendedprice"), ["lower", "upper"])


_MH = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("chart_multi_histogram", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", * FROM ({s_hist(LI_SQL, c)}) h{i}" for i, c in enumerate(_MH)))
def chart_multi_histogram(spark, sf_dir):
    return _r6(K.multi_histogram(_li(spark, sf_dir), _MH), ["lower", "upper"])


@register(
    "chart_percentiles",
    " UNION ALL ".join(
        f"SELECT 'P{int(round(p * 100))}' AS label, round(quantile_cont(o_totalprice, {p}), 6) AS value FROM orders" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    ),
)
def chart_percentiles(spark, sf_dir):
    return _r6(K.percentile_bar(table(spark, sf_dir, "orders"), "o_totalprice"), ["value"])


_BOX_OUT = ["q1", "median", "q3", "whisker_low", "whisker_high"]


def _box_sql(src: str, cols: list[str], group: str | None) -> str:
    parts = []
    g = f"{group}, " if group else ""
    gj = f"USING ({group})" if group else "ON true"
    for c in cols:
        parts.append(
            f"SELECT {g}'{c}' AS \"column\", round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, "
            f"round(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, "
            f"round(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
            f"count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers "
            f"FROM ({src}) d JOIN (SELECT {g}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 "
            f"FROM ({src}) e {'WHERE ' + group + ' IS NOT NULL GROUP BY ' + group if group else ''}) qq {gj} WHERE {c} IS NOT NULL"
            + (f" GROUP BY {group}" if group else "")
        )
    return " UNION ALL ".join(parts)


@register("chart_box_stats", _box_sql(SKEW_SQL, ["x", "z"], None))
def chart_box_stats(spark, sf_dir):
    return _r6(K.box_stats(orders_skewed(spark, sf_dir), ["x", "z"]), _BOX_OUT)


@register(
    "chart_violin_density",
    """
WITH s AS (SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS mn, max(o_totalprice) AS mx,
                  greatest(1.06 * stddev_samp(o_totalprice) * pow(count(*), -0.2), greatest(abs(min(o_totalprice)), abs(max(o_totalprice))) / 1000, 1e-9) AS h
           FROM orders GROUP BY o_orderstatus),
g AS (SELECT o_orderstatus, n, h, mn - 3 * h AS lo, (mx - mn + 6 * h) / 100 AS step FROM s),
v AS (SELECT o.o_orderstatus, (o_totalprice - lo) / step AS spot, least(floor((o_totalprice - lo) / step), 99) AS low FROM orders o JOIN g USING (o_orderstatus)),
b AS (SELECT o_orderstatus, i, sum(w) AS w FROM (
        SELECT o_orderstatus, low AS i, 1 - (spot - low) AS w FROM v UNION ALL SELECT o_orderstatus, low + 1, spot - low FROM v) u GROUP BY o_orderstatus, i)
SELECT g.o_orderstatus, CAST(p AS INTEGER) AS point, round(lo + p * step, 4) AS x,
       round(1e6 * sum(w * exp(-0.5 * pow((p - i) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density_e6
FROM g JOIN b USING (o_orderstatus), range(101) AS r(p) GROUP BY g.o_orderstatus, n, h, lo, step, p
""",
)
def chart_violin_density(spark, sf_dir):
    d = K.violin_density(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice"), "o_totalprice", "o_orderstatus")
    return d.select("o_orderstatus", "point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_e6"))


_VIOLIN_SQL = "SELECT o_orderstatus, exp(6 * o_totalprice / (SELECT max(o_totalprice) FROM orders)) AS x, o_totalprice FROM orders"


@register("chart_violin_stats", _box_sql(_VIOLIN_SQL, ["x", "o_totalprice"], "o_orderstatus"))
def chart_violin_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.agg(F.max("o_totalprice").alias("mp"))
    d = o.crossJoin(F.broadcast(m)).select("o_orderstatus", F.exp(6 * F.col("o_totalprice") / F.col("mp")).alias("x"), "o_totalprice")
    return _r6(K.box_stats(d, ["x", "o_totalprice"], group_by="o_orderstatus"), _BOX_OUT)


# ----------------------------------------------------------------- K10-K13


@register(
    "chart_value_count_bar",
    "SELECT l_partkey, count(*) AS count FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 12",
)
def chart_value_count_bar(spark, sf_dir):
    return K.value_count_bar(_li(spark, sf_dir), "l_partkey")


_SM = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "chart_sum_mean_by_category",
    "SELECT l_returnflag, "
    + ", ".join(f"round(CAST(coalesce(sum({m}), 0) AS DOUBLE), 4) AS sum_{m}, round(avg({m}), 6) AS mean_{m}" for m in _SM)
    + " FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 15",
)
def chart_sum_mean_by_category(spark, sf_dir):
    d = K.sum_mean_by_category(_li(spark, sf_dir), "l_returnflag", _SM)
    return d.select("l_returnflag", *[x for m in _SM for x in (F.round(f"sum_{m}", 4).alias(f"sum_{m}"), F.round(f"mean_{m}", 6).alias(f"mean_{m}"))])


@register("chart_grouped_bar", s_sum_by(LI_SQL, ["l_returnflag", "l_linestatus"], ["l_extendedprice"], head=30))
def chart_grouped_bar(spark, sf_dir):
    return r4(K.grouped_bar(_li(spark, sf_dir), "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_extendedprice"])


@register(
    "chart_paired_bar",
    'SELECT p_brand, round(coalesce(sum(p_retailprice), 0), 4) AS "Total", round(avg(p_retailprice), 6) AS "Average" '
    "FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY p_brand LIMIT 12",
)
def chart_paired_bar(spark, sf_dir):
    d = K.paired_bar(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return d.select("p_brand", F.round("Total", 4).alias("Total"), F.round("Average", 6).alias("Average"))


# ----------------------------------------------------------------- K14-K18


@register("chart_time_series", s_sum_by(ORD_SQL, ["o_orderdate"], ["o_totalprice"]))
def chart_time_series(spark, sf_dir):
    return r4(K.time_series(_ord(spark, sf_dir), "o_orderdate", "o_totalprice"), ["o_totalprice"])


def _rolling_sql(src: str, date: str, m: str) -> str:
    return f"""
WITH ts AS ({s_sum_by(src, [date], [m], rnd=12)}), n AS (SELECT count(*) AS n FROM ts),
w AS (SELECT CASE WHEN least(7, n // 3) = 0 THEN 3 ELSE least(7, n // 3) END AS w FROM n)
SELECT {date}, round({m}, 4) AS {m}, round(avg({m}) OVER (ORDER BY {date} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS {m}_rolling
FROM ts WHERE (SELECT n FROM n) >= 10
"""


@register("chart_rolling_average", _rolling_sql(ORD_SQL, "o_orderdate", "o_totalprice"))
def chart_rolling_average(spark, sf_dir):
    return r4(K.rolling_average_line(_ord(spark, sf_dir), "o_orderdate", "o_totalprice"), ["o_totalprice", "o_totalprice_rolling"])


@register(
    "chart_cumulative",
    f"SELECT o_orderdate, round(o_totalprice, 4) AS o_totalprice, o_totalprice_cumulative FROM ({s_cumulative(ORD_SQL, 'o_orderdate', 'o_totalprice')}) c",
)
def chart_cumulative(spark, sf_dir):
    c = K.cumulative_line(_ord(spark, sf_dir), "o_orderdate", "o_totalprice")
    return r4(c, ["o_totalprice"]).withColumn("o_totalprice_cumulative", F.round("o_totalprice_cumulative", 2))


@register("chart_multi_line", s_sum_by(ORD_SQL, ["o_orderdate"], ["o_totalprice", "o_custkey"]))
def chart_multi_line(spark, sf_dir):
    d = K.time_series(_ord(spark, sf_dir), "o_orderdate", ["o_totalprice", "o_custkey"])
    return d.select("o_orderdate", F.round(F.col("o_totalprice"), 4).alias("o_totalprice"), F.round(F.col("o_custkey").cast("double"), 4).alias("o_custkey"))


@register("chart_category_line", s_sum_by("SELECT p_type, p_retailprice FROM part", ["p_type"], ["p_retailprice"]))
def chart_category_line(spark, sf_dir):
    return r4(K.category_line(table(spark, sf_dir, "part"), "p_type", "p_retailprice"), ["p_retailprice"])


# ----------------------------------------------------------------- K20-K24


@register(
    "chart_cat_heatmap",
    'SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = \'F\'), 0), 4) AS "F", '
    "round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0), 4) AS \"O\" "
    "FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag",
)
def chart_cat_heatmap(spark, sf_dir):
    h = K.cat_heatmap(_li(spark, sf_dir), "l_returnflag", "l_linestatus", "l_quantity")
    return r4(h, ["F", "O"])


@register(
    "chart_count_crosstab",
    "SELECT o_orderpriority, "
    + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY o_orderpriority",
)
def chart_count_crosstab(spark, sf_dir):
    return K.cat_heatmap(_ord(spark, sf_dir), "o_orderpriority", "o_orderstatus")


@register(
    "chart_donut",
    "SELECT o_orderpriority, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 2) AS share FROM orders "
    "WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority",
)
def chart_donut(spark, sf_dir):
    return K.donut(_ord(spark, sf_dir), "o_orderpriority")


@register("chart_scatter", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def chart_scatter(spark, sf_dir):
    return K.scatter(_li(spark, sf_dir), "l_quantity", "l_extendedprice", "l_returnflag")


@register("chart_bubble", "SELECT o_totalprice, o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 200")
def chart_bubble(spark, sf_dir):
    return K.bubble(_ord(spark, sf_dir), "o_totalprice", "o_custkey", "o_orderkey", ["o_orderkey"], color="o_orderstatus")


def _hier_sql(measure: str | None) -> str:
    v = f"round(CAST(coalesce(sum({measure}), 0) AS DOUBLE), 4)" if measure else "CAST(count(*) AS DOUBLE)"
    return (
        f"SELECT l_returnflag, l_linestatus, CAST(CASE WHEN grouping(l_returnflag, l_linestatus) = 0 THEN 2 "
        f"WHEN grouping(l_returnflag, l_linestatus) = 1 THEN 1 ELSE 0 END AS INTEGER) AS level, {v} AS value "
        "FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ROLLUP (l_returnflag, l_linestatus)"
    )


@register("chart_treemap", _hier_sql("l_extendedprice"))
def chart_treemap(spark, sf_dir):
    return r4(K.hierarchy(_li(spark, sf_dir), "l_returnflag", "l_linestatus", "l_extendedprice"), ["value"])


@register("chart_sunburst", _hier_sql(None))
def chart_sunburst(spark, sf_dir):
    return K.hierarchy(_li(spark, sf_dir), "l_returnflag", "l_linestatus")


@register(
    "chart_funnel",
    "SELECT event_type, count(*) AS count, round(count(*) / max(count(*)) OVER () * 100, 2) AS pct_of_first "
    "FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
)
def chart_funnel(spark, sf_dir):
    return K.funnel(table(spark, sf_dir, "events"), "event_type")


@register(
    "chart_waterfall",
    """
WITH t AS (SELECT date_trunc('day', ts) AS day, sum(CASE WHEN event_type = 'error' THEN -value ELSE value END) AS delta
           FROM events GROUP BY 1)
SELECT day, round(delta, 4) AS delta,
       round(sum(delta) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - delta, 2) AS start,
       round(sum(delta) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS "end",
       CASE WHEN delta >= 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM t
""",
)
def chart_waterfall(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("delta"),
    )
    w = K.waterfall(d, "day", "delta")
    return r4(w, ["delta"]).withColumn("start", F.round("start", 2)).withColumn("end", F.round("end", 2))


@register(
    "chart_radar",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
)
def chart_radar(spark, sf_dir):
    return K.radar(_li(spark, sf_dir), "l_returnflag", "l_quantity").withColumn("value", F.round("value", 6))


# ----------------------------------------------------------------- K25-K30 dashboards


def _kpi_long_sql(src: str, metrics: list[str], order: str) -> str:
    k = s_kpi(src, metrics, order)
    texts = {"sum": "value_text", "mean": "mean_text", "min": "min_text", "max": "max_text"}
    parts = [f"SELECT 'kpi' AS chart, '{n}' AS series, metric AS x, round({n}, 4) AS y, {t} AS text FROM ({k}) p" for n, t in texts.items()]
    parts += [f"SELECT 'kpi', '{n}', metric, CAST(NULL AS DOUBLE), {n} FROM ({k}) p" for n in ("title", "trend")]
    return " UNION ALL ".join(parts)


def _sales_sql() -> str:
    src, date, m, cat = ORD_SQL, "o_orderdate", "o_totalprice", "o_orderpriority"
    parts = [
        s_long("revenue_trend", s_sum_by(src, [date], [m], rnd=12), date, [m]),
        s_long("revenue_rolling", _rolling_sql(src, date, m), date, [f"{m}_rolling"]),
        s_long("revenue_cumulative", s_cumulative(src, date, m), date, [f"{m}_cumulative"]),
        s_long("sales_by_category", s_sum_by(src, [cat], [m], rnd=12), cat, [m]),
        s_long("stacked_trend", s_sum_by(src, [date, cat], [m], rnd=12), date, [m], series=cat),
        _kpi_long_sql(src, [m], "o_orderkey"),
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


@register("dash_sales", _sales_sql())
def dash_sales(spark, sf_dir):
    return long4(D.sales_dashboard(_ord(spark, sf_dir), "o_orderdate", "o_totalprice", "o_orderpriority", order_by=["o_orderkey"]))


_FIN_SRC = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"


def _finance_sql() -> str:
    src, date, ms = _FIN_SRC, "o_orderdate", ["o_totalprice", "o_custkey"]
    ts = s_sum_by(src, [date], ms, rnd=12)
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {'max(1.0)' if a == b else f'corr({a}, {b})'} AS corr FROM ({src}) d" for a in nums for b in nums
    )
    parts = [s_long("multi_trend", ts, date, ms)]
    parts += [s_long(f"{m}_trend", ts, date, [m]) for m in ms]
    parts.append(s_long("correlation", corr, "col2", ["corr"], series="col1"))
    parts += [s_long(f"dist_{m}", s_hist(src, m), "bin", ["count"]) for m in ms]
    parts.append(_kpi_long_sql(src, ms, "o_orderkey"))
    return " UNION ALL ".join(f"({p})" for p in parts)


@register("dash_finance", _finance_sql())
def dash_finance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return long4(D.finance_dashboard(o, "o_orderdate", ["o_totalprice", "o_custkey"], order_by=["o_orderkey"]))


_CUST_SQL = "SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer"


@register(
    "dash_hr",
    " UNION ALL ".join(
        [
            "("
            + s_long(
                "salary_by_dept",
                "SELECT c_mktsegment, avg(c_acctbal) AS mean, coalesce(sum(c_acctbal), 0) AS sum, count(c_acctbal) AS count "
                "FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment",
                "c_mktsegment",
                ["mean", "sum", "count"],
            )
            + ")",
            "(" + _kpi_long_sql(_CUST_SQL, ["c_acctbal"], "c_custkey") + ")",
        ]
    ),
)
def dash_hr(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return long4(D.hr_dashboard(c, "c_mktsegment", "c_acctbal", order_by=["c_custkey"]))


@register(
    "dash_marketing",
    " UNION ALL ".join(
        [
            "(" + s_long("spend_by_channel", s_sum_by(_CUST_SQL, ["c_mktsegment"], ["c_acctbal"], rnd=12), "c_mktsegment", ["c_acctbal"]) + ")",
            "(" + s_long("conversion_hist", s_hist(_CUST_SQL, "c_nationkey"), "bin", ["count"]) + ")",
            "(" + _kpi_long_sql(_CUST_SQL, ["c_acctbal", "c_nationkey"], "c_custkey") + ")",
        ]
    ),
)
def dash_marketing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return long4(D.marketing_dashboard(c, "c_mktsegment", "c_acctbal", "c_nationkey", order_by=["c_custkey"]))


_AUTO_SRC = "SELECT o_totalprice, o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders"
_AUTO_COLS = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


_WIDE_SRC = f"SELECT price, o_custkey, o_orderkey % 50 AS qty, status, o_orderpriority, odate, o_orderkey FROM ({NULLS_SQL}) n"
_WIDE_COLS = ["price", "o_custkey", "qty", "status", "o_orderpriority", "odate", "o_orderkey"]


def _wide(spark, sf_dir):
    n = orders_nulls(spark, sf_dir)
    return n.select("price", "o_custkey", (F.col("o_orderkey") % 50).alias("qty"), "status", "o_orderpriority", "odate", "o_orderkey")


def _auto_sql(src: str, cols: list[str], nums: list[str], cats: list[str], dcol: str, order: str) -> str:
    """The charts of an automatic dashboard, listed one by one."""
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    gauges = f"""
WITH s AS (SELECT count(*) AS n, {miss} AS m FROM ({src}) d), u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM ({src}) x) y)
SELECT 'completeness' AS gauge, round((n * {len(cols)} - m) / (n * {len(cols)}) * 100, 1) AS value FROM s
UNION ALL SELECT 'uniqueness', 100.0 - round((n - d) / n * 100, 1) FROM s, u"""
    parts = [s_long("gauges", gauges, "gauge", ["value"])]
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {'max(1.0)' if a == b else f'corr({a}, {b})'} AS corr FROM ({src}) d" for a in nums for b in nums
    )
    parts.append(s_long("correlation_heatmap", corr, "col2", ["corr"], series="col1"))
    for c in nums[:4]:
        parts.append(s_long(f"hist_{c}", s_hist(src, c), "bin", ["count"]))
        parts.append(s_long("overlaid_histograms", f"SELECT '{c}' AS col, * FROM ({s_hist(src, c)}) z", "bin", ["count"], series="col"))
    parts.append(s_long("box", _box_sql(src, nums[:3], None), '"column"', _BOX_OUT + ["outliers"]))
    for c in cats:
        vc = f"SELECT {c}, count(*) AS count FROM ({src}) s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} LIMIT 12"
        parts.append(s_long(f"bar_{c}", vc, c, ["count"]))
    cat, m0 = cats[0], nums[0]
    for m in nums[:2]:
        parts.append(s_long(f"sum_{m}_by_{cat}", s_sum_by(src, [cat], [m], head=12, rnd=12), cat, [m]))
        avg = f"SELECT {cat}, avg({m}) AS {m} FROM ({src}) s WHERE {cat} IS NOT NULL GROUP BY {cat} ORDER BY {cat} LIMIT 12"
        parts.append(s_long(f"avg_{m}_by_{cat}", avg, cat, [m]))
        parts.append(s_long(f"violin_{m}", _box_sql(src, [m], cat), cat, _BOX_OUT + ["outliers"]))
    pairs = f"FROM ({src}) s WHERE {cats[0]} IS NOT NULL AND {cats[1]} IS NOT NULL GROUP BY {cats[0]}, {cats[1]}"
    for chart in ("grouped_bar", "stacked_bar"):
        parts.append(s_long(chart, s_sum_by(src, cats[:2], [m0], head=30, rnd=12), cats[0], [m0], series=cats[1]))
    for chart in ("cat_heatmap", "treemap"):
        parts.append(s_long(chart, f"SELECT {cats[0]}, {cats[1]}, coalesce(sum({m0}), 0) AS value {pairs}", cats[0], ["value"], series=cats[1]))
    parts.append(s_long("sunburst", f"SELECT {cats[0]}, {cats[1]}, count(*) AS value {pairs}", cats[0], ["value"], series=cats[1]))
    for c in cats[:3]:
        parts.append(s_long(f"donut_{c}", f"SELECT {c}, count(*) AS count FROM ({src}) s WHERE {c} IS NOT NULL GROUP BY {c}", c, ["count"]))
    for m in nums[:3]:
        parts.append(s_long(f"line_{m}", s_sum_by(src, [dcol], [m], rnd=12), dcol, [m]))
        parts.append(s_long(f"rolling_{m}", _rolling_sql(src, dcol, m), dcol, [f"{m}_rolling"]))
    parts.append(s_long("multi_line", s_sum_by(src, [dcol], nums[:4], rnd=12), dcol, nums[:4]))
    for m in nums[:2]:
        parts.append(s_long(f"cumulative_{m}", s_cumulative(src, dcol, m), dcol, [f"{m}_cumulative"]))
    parts.append(s_long("scatter_xy", f"SELECT * FROM ({src}) s", nums[0], [nums[1]], series=cat))
    if len(nums) >= 3:
        parts.append(s_long("bubble_xy", f"SELECT * FROM ({src}) s ORDER BY {order} LIMIT 200", nums[0], nums[1:3]))
    lost = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS missing_count FROM ({src}) s" for c in cols)
    parts.append(s_long("missing_values", f"SELECT * FROM ({lost}) m WHERE missing_count > 0 ORDER BY missing_count DESC, col LIMIT 10", "col", ["missing_count"]))
    parts.append(_kpi_long_sql(src, nums[:4], order))
    return " UNION ALL ".join(f"({p})" for p in parts)


_CATS = ["o_orderstatus", "o_orderpriority"]


@register("dash_auto", _auto_sql(_AUTO_SRC, _AUTO_COLS, ["o_totalprice", "o_custkey"], _CATS, "o_orderdate", "o_orderdate, o_totalprice, o_custkey"))
def dash_auto(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*_AUTO_COLS)
    return long4(D.auto_dashboard(o, order_by=["o_orderdate", "o_totalprice", "o_custkey"]))


_WIDE_NUMS = ["price", "o_custkey", "qty", "o_orderkey"]


@register("dash_auto_wide", _auto_sql(_WIDE_SRC, _WIDE_COLS, _WIDE_NUMS, ["status", "o_orderpriority"], "odate", "o_orderkey"))
def dash_auto_wide(spark, sf_dir):
    """Four numbers, missing values in numbers, categories and dates."""
    return long4(D.auto_dashboard(_wide(spark, sf_dir), order_by=["o_orderkey"]))


def _report_index_sql(src: str, cols: list[str], nums: list[str], cats: list[str], dcol: str) -> str:
    """The charts of a report with their rows, listed one by one."""
    ncols = " + ".join(f"(CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)" for c in cols)
    miss = f"(SELECT {ncols} AS k, count(*) AS n FROM ({src}) s)"
    distinct = lambda c: f"(SELECT count(DISTINCT {c}) FROM ({src}) s)"
    total = f"(SELECT count(*) FROM ({src}) s)"
    pairs = f"(SELECT count(*) FROM (SELECT DISTINCT {cats[0]}, {cats[1]} FROM ({src}) s WHERE {cats[0]} IS NOT NULL AND {cats[1]} IS NOT NULL) p)"
    hist = {c: f"(SELECT count(*) FROM ({s_hist(src, c)}) h)" for c in nums[:6]}
    out = [("quality_completeness", "quality", "1"), ("quality_duplicates", "quality", "1")]
    out += [(f"hist_{c}", "distribution", h) for c, h in hist.items()]
    out += [(f"percentile_{c}", "distribution", "7") for c in nums[:3]]
    out.append(("overlaid_histograms", "distribution", " + ".join(hist[c] for c in nums[:4])))
    out += [(f"box_{c}", "distribution", "1") for c in nums[:4]]
    cat = cats[0]
    for m in nums[:3]:
        out.append((f"violin_{m}", "distribution", f"(SELECT count(DISTINCT {cat}) FROM ({src}) s WHERE {m} IS NOT NULL)"))
        out += [(f"bar_{k}_{m}_by_{cat}", "bars", f"least(15, {distinct(cat)})") for k in ("sum", "mean")]
        out += [(f"line_{dcol}_{m}", "lines", distinct(dcol)), (f"rolling_{dcol}_{m}", "lines", distinct(dcol)), (f"cumulative_{dcol}_{m}", "lines", distinct(dcol))]
    for c in cats[:5]:
        out += [(f"{k}_{c}", "bars", f"least(12, {distinct(c)})") for k in ("bar", "hbar")]
    out += [(k, "bars", f"least(30, {pairs})") for k in ("grouped_bar", "stacked_bar")]
    out.append(("paired_bar_sum_mean", "bars", f"least(12, {distinct(cat)})"))
    out.append((f"multiline_{dcol}", "lines", distinct(dcol)))
    out += [(f"line_by_{cat}_{m}", "lines", distinct(cat)) for m in nums[:2]]
    out.append(("correlation_heatmap", "heatmaps", str(len(nums) ** 2)))
    out += [(f"heatmap_{cats[0]}_{cats[1]}_{m}", "heatmaps", pairs) for m in nums[:2]]
    out.append((f"heatmap_counts_{cats[0]}_{cats[1]}", "heatmaps", pairs))
    out += [(f"donut_{c}", "composition", distinct(c)) for c in cats[:3]]
    out.append(("scatter_xy", "scatter", total))
    if len(nums) >= 3:
        out += [("scatter_xz", "scatter", total), ("bubble_xy", "scatter", f"least(200, {total})")]
    out += [("treemap", "hierarchy", pairs), ("sunburst", "hierarchy", pairs)]
    parts = [f"SELECT '{c}' AS chart, '{s}' AS section, CAST({r} AS BIGINT) AS rows" for c, s, r in out]
    parts += [f"SELECT 'missing_values_{k}', 'quality', CAST(least(15, k) AS BIGINT) FROM {miss} m WHERE k > 0" for k in ("bar", "hbar")]
    parts.append(f"SELECT 'missing_pattern_heatmap', 'quality', CAST(least(50, n) * {len(cols)} AS BIGINT) FROM {miss} m WHERE k > 0")
    return " UNION ALL ".join(parts)


@register("report_charts_index", _report_index_sql(_AUTO_SRC, _AUTO_COLS, ["o_totalprice", "o_custkey"], _CATS, "o_orderdate"))
def report_charts_index(spark, sf_dir):
    """Chart list of the report for orders with each chart dataset's row count."""
    return D.report_chart_index(table(spark, sf_dir, "orders").select(*_AUTO_COLS))


@register("report_charts_wide", _report_index_sql(_WIDE_SRC, _WIDE_COLS, _WIDE_NUMS, ["status", "o_orderpriority"], "odate"))
def report_charts_wide(spark, sf_dir):
    return D.report_chart_index(_wide(spark, sf_dir))


# ------------------------------------------- K03: each chart type, and named columns


@register("chart_by_type_line", "SELECT o_orderdate, o_totalprice FROM orders")
def chart_by_type_line(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate", "o_orderstatus"), "show the growth")
    return data if kind == "line" else None


@register("chart_by_type_pie", s_sum_by("SELECT * FROM orders", ["o_orderstatus"], ["o_totalprice"], head=10))
def chart_by_type_pie(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice"))
    return r4(data, ["o_totalprice"]) if kind == "pie" else None


@register("chart_by_type_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem")
def chart_by_type_scatter(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"))
    return data if kind == "scatter" else None


@register("chart_by_type_histogram", s_hist("SELECT * FROM lineitem", "l_extendedprice"))
def chart_by_type_histogram(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag"), "its distribution")
    return _r6(data, ["lower", "upper"]) if kind == "histogram" else None


@register(
    "chart_by_type_heatmap",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {'1.0' if a == b else f'round(corr({a}, {b}), 6)'} AS corr FROM lineitem"
        + (" LIMIT 1" if a == b else "")
        for a, b in [("l_quantity", "l_extendedprice"), ("l_extendedprice", "l_quantity")]
    )
    + " UNION ALL SELECT * FROM (VALUES ('l_quantity', 'l_quantity', 1.0), ('l_extendedprice', 'l_extendedprice', 1.0)) v",
)
def chart_by_type_heatmap(spark, sf_dir):
    kind, data = K.auto_chart(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "a heatmap")
    return _r6(data, ["corr"]) if kind == "heatmap" else None


@register("chart_named_columns", s_sum_by(LI_SQL, ["l_linestatus"], ["l_discount"], head=20))
def chart_named_columns(spark, sf_dir):
    return r4(K.chart_data(_li(spark, sf_dir), "bar", "l_linestatus", "l_discount"), ["l_discount"])
