"""The data behind each chart, as DataFrames (never figures).

Aggregations run where the data lives; only what a chart shows leaves Spark.
``head(n)`` after a group-by in the reference means the first ``n`` keys in key
order, and is kept that way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import categorical_columns, date_columns, numeric_columns, value_or_null
from ..operators import prefix
from ..operators.cleaning import q
from ..operators.quality import missing_by_column
from ..operators.quantiles import column_quantiles, exact_quantiles, grouped_quantiles
from ..operators.transform import widen

# Fixed values from the reference: intent word -> chart type, checked in this order.
INTENT_CHART = [
    ("trend", "line"),
    ("compare", "bar"),
    ("distribution", "histogram"),
    ("composition", "pie"),
    ("correlation", "scatter"),
    ("relationship", "scatter"),
    ("heatmap", "heatmap"),
    ("growth", "line"),
    ("ranking", "bar"),
    ("partofwhole", "pie"),
]
PERCENTILE_BAR = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


# ---------------------------------------------------------------- K01 KPI cards
def kpi_cards(df: DataFrame, metrics: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Sum, mean, min, max and trend (last vs first row by ``order_by``) per metric,
    plus the reference's text forms (``%,.2f``; integers ``%,d``). One aggregate."""
    cols = metrics or numeric_columns(df)[:4]
    key = F.struct(*[q(o) for o in order_by]) if order_by else None
    x = lambda c: value_or_null(df, c)  # noqa: E731 - NaN is missing
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        exprs += [
            F.sum(x(c)).alias(f"s{i}"), F.avg(x(c)).alias(f"m{i}"), F.min(x(c)).alias(f"lo{i}"), F.max(x(c)).alias(f"hi{i}"),
        ]
        if key is not None:
            exprs += [F.min_by(x(c), key).alias(f"f{i}"), F.max_by(x(c), key).alias(f"l{i}")]
    agg = df.select(*exprs)
    integral = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "byte")}
    cards = []
    for i, c in enumerate(cols):
        s = F.col(f"s{i}")
        value_text = F.format_number(s, 0) if c in integral else F.format_number(s, 2)
        trend = F.lit("neutral")
        if key is not None:
            trend = F.when(F.col(f"l{i}") > F.col(f"f{i}"), "up").when(F.col("__n") > 1, "down").otherwise("neutral")
        cards.append(
            F.struct(
                F.lit(c).alias("metric"),
                F.lit(c.replace("_", " ").title()).alias("title"),
                s.cast("double").alias("sum"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"lo{i}").cast("double").alias("min"),
                F.col(f"hi{i}").cast("double").alias("max"),
                trend.alias("trend"),
                value_text.alias("value_text"),
                F.format_number(F.col(f"m{i}"), 2).alias("mean_text"),
                F.format_number(F.col(f"lo{i}").cast("double"), 2).alias("min_text"),
                F.format_number(F.col(f"hi{i}").cast("double"), 2).alias("max_text"),
            )
        )
    return agg.select(F.explode(F.array(*cards)).alias("c")).select("c.*")


# ------------------------------------------------------------ K02 chart type
def chart_type_for_intent(question: str | Column) -> Column:
    """Chart type named by the first intent word found in the question, else null."""
    qc = F.lower(F.col(question) if isinstance(question, str) else question)
    out = None
    for word, chart in INTENT_CHART:
        cond = qc.contains(word)
        out = F.when(cond, F.lit(chart)) if out is None else out.when(cond, F.lit(chart))
    return out


def detect_chart_type(df: DataFrame, user_intent: str | None = None) -> str:
    """K02 on a frame: intent words first, then column classes (one small job
    only when the first text column decides between pie and bar)."""
    if user_intent:
        low = user_intent.lower()
        for word, chart in INTENT_CHART:
            if word in low:
                return chart
    nums, cats, dates = numeric_columns(df), categorical_columns(df), date_columns(df)
    if dates and nums:
        return "line"
    if cats and nums:
        n = df.select(F.countDistinct(q(cats[0]))).first()[0]
        return "pie" if n <= 5 else "bar"
    if len(nums) >= 3:
        return "scatter_matrix"
    if len(nums) == 2:
        return "scatter"
    if nums:
        return "histogram"
    return "bar"


# --------------------------------------------------------------- helpers
def sum_by(df: DataFrame, key: str | list[str], measures: list[str], head: int | None = None) -> DataFrame:
    """pandas ``groupby(key)[m].sum()`` (null keys dropped, all-null sum = 0),
    sorted by key, first ``head`` keys."""
    keys = [key] if isinstance(key, str) else list(key)
    base = df
    for k in keys:
        base = base.where(q(k).isNotNull())
    out = base.groupBy(*[q(k) for k in keys]).agg(*[F.coalesce(F.sum(value_or_null(df, m)), F.lit(0)).alias(m) for m in measures])
    out = out.orderBy(*keys)
    return out.limit(head) if head else out


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(q(key).isNotNull()).groupBy(q(key)).agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------- K03 auto chart
def _line_data(df, x, y):
    return df.select(q(x), q(y))


def _heat_data(df, x=None, y=None):
    from ..operators.profile import correlation_long

    return correlation_long(df)


#: What each chart type is drawn from: the column classes its axes take when the
#: user names none (n number, c category, d date), and its data.
CHART_DATA = {
    "line": ("dn", _line_data),
    "pie": ("cn", lambda df, x, y: sum_by(df, x, [y], head=10)),
    "bar": ("cn", lambda df, x, y: sum_by(df, x, [y], head=20)),
    "scatter": ("nn", lambda df, x, y: scatter(df, x, y, next(iter(categorical_columns(df)), None))),
    "histogram": ("n", lambda df, x: histogram(df, x)),
    "heatmap": ("nn", _heat_data),
}


def _axes(df: DataFrame, classes: str) -> list[str] | None:
    """First columns of the wanted classes, each column once; None if short."""
    left = {"n": numeric_columns(df), "c": categorical_columns(df), "d": date_columns(df)}
    picked = []
    for k in classes:
        if not left[k]:
            return None
        picked.append(left[k].pop(0))
    return picked


def chart_data(df: DataFrame, chart: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """The data of a chart of the named type, on the given columns or on the
    first ones of the classes it takes."""
    if chart not in CHART_DATA:
        raise ValueError(f"unknown chart type {chart!r}")
    classes, data = CHART_DATA[chart]
    named = [c for c in (x, y) if c is not None]
    for c in named:
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    axes = named if len(named) >= len(classes) else _axes(df, classes)
    if axes is None:
        raise ValueError(f"{chart} needs columns of the classes {classes}")
    return data(df, *axes[: len(classes)])


def auto_chart(df: DataFrame, user_intent: str | None = None) -> tuple[str, DataFrame]:
    """Chart type and data for a question: the detected type where the columns
    allow it, else a histogram of the first number, else the first two columns."""
    for kind in (detect_chart_type(df, user_intent), "histogram"):
        if kind in CHART_DATA and _axes(df, CHART_DATA[kind][0]) is not None:
            return kind, chart_data(df, kind)
    return "bar", df.select(*[q(c) for c in df.columns[:2]])


# -------------------------------------------------------- K04-K06 quality
def _zone(v: Column, top: float = 100.0) -> Column:
    return F.when(v < top * 0.3, "low").when(v < top * 0.7, "mid").otherwise("high")


def _row_hash(df: DataFrame) -> list[Column]:
    """128 bits per row in place of the row itself: two hashes of its values and
    of which of them are null (a hash skips nulls)."""
    nulls = [
        sum((F.col(f"`{c}`").isNull().cast("long") * (1 << i) for i, c in enumerate(df.columns[at : at + 60])), F.lit(0).cast("long"))
        for at in range(0, len(df.columns), 60)
    ]
    values = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*nulls, *values).alias("a"), F.xxhash64(F.lit(7), *reversed(values), *nulls).alias("b")]


def quality_gauges(df: DataFrame) -> DataFrame:
    """Completeness % and uniqueness % (1 decimal) with gauge zone."""
    ncols = len(df.columns)
    miss = missing_by_column(df).agg(F.coalesce(F.sum("missing_count"), F.lit(0)).alias("m"))
    n = df.select(F.count(F.lit(1)).alias("n"))
    d = df.select(*_row_hash(df)).distinct().select(F.count(F.lit(1)).alias("d"))
    s = n.crossJoin(d).crossJoin(miss)
    cells = F.col("n") * F.lit(ncols)
    comp = F.when(cells > 0, F.round((cells - F.col("m")) / cells * 100, 1)).otherwise(0.0)
    dup = F.when(F.col("n") > 0, F.round((F.col("n") - F.col("d")) / F.col("n") * 100, 1)).otherwise(0.0)
    uniq = F.lit(100.0) - dup
    return s.select(
        F.explode(
            F.array(
                F.struct(F.lit("completeness").alias("gauge"), comp.alias("value"), _zone(comp).alias("zone")),
                F.struct(F.lit("uniqueness").alias("gauge"), uniq.alias("value"), _zone(uniq).alias("zone")),
            )
        ).alias("g")
    ).select("g.*")


def missing_bar(df: DataFrame, top: int = 15) -> DataFrame:
    """Columns with missing values, most first (ties by name), first ``top``."""
    return missing_by_column(df).where(F.col("missing_count") > 0).orderBy(F.col("missing_count").desc(), "column").limit(top)


def missing_pattern(df: DataFrame, order_by: list[str], rows: int = 50) -> DataFrame:
    """0/1 missing matrix of the first ``rows`` rows, long form (row, column, missing)."""
    head = df.orderBy(*order_by).limit(rows)
    head = head.withColumn("__row", F.row_number().over(Window.orderBy(*order_by)) - 1)
    cells = [F.struct(F.lit(c).alias("column"), q(c).isNull().cast("int").alias("missing")) for c in df.columns]
    return head.select("__row", F.explode(F.array(*cells)).alias("c")).select(F.col("__row").alias("row"), "c.*")


# ------------------------------------------------------ K07-K09 distributions
def _finite(df: DataFrame, column: str) -> Column:
    """The column as double; NaN and infinities are missing."""
    x = value_or_null(df, column).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def value_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(min, max) of several columns in one aggregate."""
    if not columns:
        return {}
    r = df.select(
        *[F.min(_finite(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(_finite(df, c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(columns)}


def histogram(df: DataFrame, column: str, bins: int = 20, value_range: tuple | None = None) -> DataFrame:
    """Equal-width bins over [min, max], left-closed, the last closed; (bin, lower, upper, count)."""
    a, b = value_range or value_ranges(df, [column])[column]
    if a is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    w = (b - a) / bins if b > a else 1.0
    x = _finite(df, column)
    idx = F.least(F.lit(bins - 1), F.floor((x - F.lit(a)) / F.lit(w))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin", (F.lit(a) + F.col("bin") * F.lit(w)).alias("lower"), (F.lit(a) + (F.col("bin") + 1) * F.lit(w)).alias("upper"), "count"
    )


def multi_histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Overlaid histograms of up to 4 numeric columns, long form."""
    cols = (columns or numeric_columns(df))[:4]
    ranges = value_ranges(df, cols)
    parts = [histogram(df, c, bins, ranges[c]).select(F.lit(c).alias("column"), "*") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percentile_bar(df: DataFrame, column: str) -> DataFrame:
    vals = column_quantiles(df, [column], PERCENTILE_BAR)[column]
    rows = [(f"P{int(round(p * 100))}", v) for p, v in zip(PERCENTILE_BAR, vals)]
    return df.sparkSession.createDataFrame(rows, "label string, value double")


def box_stats(df: DataFrame, columns: list[str], group_by: str | None = None, stats: dict | None = None) -> DataFrame:
    """Box / violin statistics: q1, median, q3, whiskers (extreme values within
    1.5 IQR) and outlier count, per column (and group)."""
    groups = [group_by] if group_by else []
    base = df.where(q(group_by).isNotNull()) if group_by else df
    if groups:
        qdf = grouped_quantiles(base, columns, [0.25, 0.5, 0.75], groups).select(
            *[q(g) for g in groups], F.col("__series").alias("column"),
            F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        )
    else:  # one row per column
        qs = exact_quantiles(base, columns, [0.25, 0.5, 0.75], stats=stats)
        rows = [(k[-1], *v) for k, v in qs.items() if v[0] is not None]
        qdf = F.broadcast(df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double"))
    long = base.select(
        *[q(g) for g in groups],
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value_or_null(df, c).cast("double").alias("x")) for c in columns])).alias("p"),
    ).select(*groups, "p.column", "p.x").where(F.col("x").isNotNull())
    j = long.join(qdf, groups + ["column"])  # AQE broadcasts or splits by its size
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    agg = j.groupBy(*groups, "column", "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_high"),
        F.count(F.when((F.col("x") < lo) | (F.col("x") > hi), 1)).alias("outliers"),
    )
    return agg


#: Grid points of a violin, and how many bandwidths it goes beyond its values.
VIOLIN_POINTS, VIOLIN_REACH = 101, 3.0


def violin_density(df: DataFrame, column: str, group_by: str, points: int = VIOLIN_POINTS) -> DataFrame:
    """(``group_by``, point, x, density): a Gaussian kernel density per
    group on ``points`` grid points. Bandwidth 1.06 s n^(-1/5) (at least a
    thousandth of the largest value, for groups that do not vary). Values are
    shared out to their two neighbouring grid points (one aggregate per group and
    point, combined map-side), and each grid point adds the kernel over these
    bins, so the work after one pass is ``points`` squared per group. Missing and
    infinite values and null groups do not count."""
    x = value_or_null(df, column).cast("double")
    base = df.select(q(group_by), x.alias("x")).where(q(group_by).isNotNull() & (F.abs("x") < float("inf")))
    stats = base.groupBy(group_by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    spread = 1.06 * F.coalesce("s", F.lit(0.0)) * F.pow(F.col("n"), F.lit(-0.2))
    h = F.greatest(spread, F.greatest(F.abs("lo"), F.abs("hi")) / 1000, F.lit(1e-9))
    stats = stats.withColumn("h", h).select(
        group_by, "n", "h", (F.col("lo") - VIOLIN_REACH * F.col("h")).alias("lo"),
        ((F.col("hi") - F.col("lo") + 2 * VIOLIN_REACH * F.col("h")) / (points - 1)).alias("step"),
    )
    place = base.join(stats, group_by).select(group_by, "n", "h", "lo", "step", ((F.col("x") - F.col("lo")) / F.col("step")).alias("at"))
    low = F.least(F.floor("at"), F.lit(points - 2))
    shares = F.array(
        F.struct(low.alias("i"), (1 - (F.col("at") - low)).alias("w")), F.struct((low + 1).alias("i"), (F.col("at") - low).alias("w"))
    )
    bins = place.select(group_by, "n", "h", "lo", "step", F.explode(shares).alias("b")).groupBy(
        group_by, "n", "h", "lo", "step", F.col("b.i").alias("i")
    ).agg(F.sum("b.w").alias("w"))
    grid = bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.exp(-0.5 * F.pow((F.col("point") - F.col("i")) * F.col("step") / F.col("h"), F.lit(2.0)))
    summed = grid.groupBy(group_by, "n", "h", "lo", "step", "point").agg(F.sum(F.col("w") * kernel).alias("k"))
    return summed.select(
        group_by, "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.col("k") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )


# --------------------------------------------------------- K10-K13 bars
def value_count_bar(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    return count_by(df, column).orderBy(F.col("count").desc(), q(column)).limit(top)


def sum_mean_by_category(df: DataFrame, category: str, measures: list[str], head: int = 15) -> DataFrame:
    base = df.where(q(category).isNotNull())
    aggs = []
    for m in measures:
        aggs += [F.coalesce(F.sum(q(m)), F.lit(0)).alias(f"sum_{m}"), F.avg(q(m)).alias(f"mean_{m}")]
    return base.groupBy(q(category)).agg(*aggs).orderBy(category).limit(head)


def grouped_bar(df: DataFrame, c1: str, c2: str, measure: str, head: int = 30) -> DataFrame:
    return sum_by(df, [c1, c2], [measure], head=head)


def paired_bar(df: DataFrame, category: str, measure: str, head: int = 12) -> DataFrame:
    base = df.where(q(category).isNotNull())
    return (
        base.groupBy(q(category))
        .agg(F.coalesce(F.sum(q(measure)), F.lit(0)).alias("Total"), F.avg(q(measure)).alias("Average"))
        .orderBy(category)
        .limit(head)
    )


# --------------------------------------------------------- K14-K18 lines
def time_series(df: DataFrame, date: str, measures: list[str] | str) -> DataFrame:
    """Sum per date value, ascending (K14; K17 with several measures)."""
    ms = [measures] if isinstance(measures, str) else list(measures)
    return sum_by(df, date, ms)


def rolling_average_line(df: DataFrame, date: str, measure: str, **kw) -> DataFrame:
    """Per-date sums with a ``min(7, n // 3)``-point rolling mean
    (``min_periods=1``), only when there are at least 10 dates."""
    ts = time_series(df, date, measure)
    n = ts.count()
    if n < 10:
        return ts.select(date, measure, F.lit(None).cast("double").alias(f"{measure}_rolling")).limit(0)
    w = min(7, n // 3) or 3
    return prefix.rolling_mean(ts, measure, w, [date], name=f"{measure}_rolling", min_periods=1, **kw)


def cumulative_line(df: DataFrame, date: str, measure: str, **kw) -> DataFrame:
    """Per-date sums and their running total."""
    ts = time_series(df, date, measure)
    return prefix.running(ts, {f"{measure}_cumulative": ("sum", measure)}, [date], keep_null_rows=False, **kw)


def category_line(df: DataFrame, category: str, measure: str) -> DataFrame:
    return sum_by(df, category, [measure])


# ------------------------------------------------------ K20-K24 composites
def cat_heatmap(df: DataFrame, c1: str, c2: str, measure: str | None = None) -> DataFrame:
    """Pivot of sum(measure) (or row count) by c1 x c2, missing cells 0."""
    return widen(cat_cells(df, c1, c2, measure), c1, fill=0)


def cat_cells(df: DataFrame, c1: str, c2: str, measure: str | None = None) -> DataFrame:
    """The cells of K20 in long form (c1, column, value), whatever their number."""
    base = df.where(q(c1).isNotNull() & q(c2).isNotNull())
    cell = F.coalesce(F.sum(value_or_null(df, measure)), F.lit(0)) if measure else F.count(F.lit(1))
    return base.groupBy(q(c1), q(c2).cast("string").alias("column")).agg(cell.alias("value"))


def donut(df: DataFrame, column: str, max_values: int = 8, n_values: int | None = None) -> DataFrame | None:
    """Counts and share of total when the column has at most ``max_values`` values."""
    counts = count_by(df, column)
    if (n_values if n_values is not None else counts.count()) > max_values:
        return None
    total = counts.agg(F.sum("count").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(q(column), "count", F.round(F.col("count") / F.col("__t") * 100, 2).alias("share"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    return df.select(q(x), q(y), *([q(color)] if color else []))


def bubble(df: DataFrame, x: str, y: str, size: str, order_by: list[str], color: str | None = None, rows: int = 200) -> DataFrame:
    """K22 bubble: the first ``rows`` rows (the reference's ``head(200)``)."""
    return df.orderBy(*order_by).limit(rows).select(q(x), q(y), q(size), *([q(color)] if color else []))


def hierarchy(df: DataFrame, c1: str, c2: str, measure: str | None = None) -> DataFrame:
    """K23 treemap / sunburst: leaves (c1, c2), parents (c1) and the root via
    ``rollup``; ``level`` 2 = leaf, 1 = parent, 0 = root."""
    base = df.where(q(c1).isNotNull() & q(c2).isNotNull())
    val = F.coalesce(F.sum(q(measure)), F.lit(0)).cast("double") if measure else F.count(F.lit(1)).cast("double")
    out = base.rollup(q(c1), q(c2)).agg(val.alias("value"), F.grouping_id().alias("__g"))
    level = F.when(F.col("__g") == 0, 2).when(F.col("__g") == 1, 1).otherwise(0)
    return out.select(c1, c2, level.alias("level"), "value")


def funnel(df: DataFrame, stage: str) -> DataFrame:
    """K24 funnel: row count per stage, largest first, with % of the first stage."""
    c = count_by(df, stage)
    top = c.agg(F.max("count").alias("__m"))
    return c.crossJoin(F.broadcast(top)).select(
        q(stage), "count", F.round(F.col("count") / F.col("__m") * 100, 2).alias("pct_of_first")
    )


def waterfall(df: DataFrame, x: str, y: str, **kw) -> DataFrame:
    """K24 waterfall over per-x sums: start, end and direction of each step."""
    ts = time_series(df, x, y)
    r = prefix.running(ts, {"__end": ("sum", y)}, [x], keep_null_rows=False, **kw)
    return r.select(
        x, y, (F.col("__end") - F.col(y)).alias("start"), F.col("__end").alias("end"),
        F.when(F.col(y) >= 0, "increase").otherwise("decrease").alias("direction"),
    )


def radar(df: DataFrame, category: str, measure: str) -> DataFrame:
    return df.where(q(category).isNotNull()).groupBy(q(category)).agg(F.avg(q(measure)).alias("value")).orderBy(category)
