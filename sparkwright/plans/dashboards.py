"""Dashboards and the report chart set as one long-form DataFrame
``(chart, series, x, y)``; every part is a chart dataset from :mod:`chartdata`.
The input is scanned by each part's own aggregate; cache it first when the
caller can afford the memory (``df.persist()``), otherwise Spark re-reads the
(pruned) columns per part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import categorical_columns, date_columns, is_missing, numeric_columns, value_or_null
from ..operators.cleaning import q
from ..operators import prefix
from . import chartdata as K


def long(chart: str, df: DataFrame, x: str, ys: list[str], series: str | None = None) -> DataFrame:
    """Reshape a chart dataset to (chart, series, x, y, text)."""
    none = F.lit(None).cast("string").alias("text")
    pairs = [(q(series).cast("string"), ys[0])] if series else [(F.lit(y), y) for y in ys]
    return _union([
        df.select(F.lit(chart).alias("chart"), s.alias("series"), q(x).cast("string").alias("x"), q(y).cast("double").alias("y"), none)
        for s, y in pairs
    ])


def kpi_rows(df: DataFrame, metrics: list[str], order_by: list[str] | None) -> DataFrame:
    """KPI cards: a row per field, numbers in y and their text forms, the title
    and the trend in text."""
    cards = K.kpi_cards(df, metrics, order_by)
    numbers = {"sum": "value_text", "mean": "mean_text", "min": "min_text", "max": "max_text"}
    fields = [F.struct(F.lit(n).alias("series"), F.col(n).alias("y"), F.col(t).alias("text")) for n, t in numbers.items()]
    fields += [F.struct(F.lit(n).alias("series"), F.lit(None).cast("double").alias("y"), F.col(n).alias("text")) for n in ("title", "trend")]
    each = cards.select(F.col("metric").alias("x"), F.explode(F.array(*fields)).alias("f"))
    return each.select(F.lit("kpi").alias("chart"), "f.series", "x", "f.y", "f.text")


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union many same-schema parts as a balanced tree: each step is analysed
    eagerly, so a left-deep chain of n unions costs O(n^2) analysis."""
    parts = [p for p in parts if p is not None]
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


#: Grouped rows up to which they are one partition.
ONE_PARTITION_ROWS = 200_000


class OnePass:
    """One ``GROUPING SETS`` aggregate serving many charts: each named set of
    key columns becomes one grouping; every group carries row count and sum /
    mean / min / max of every measure. The grouped result (a row per group) is
    small and is checkpointed once; ``part(name)`` filters one grouping with
    non-null keys. Histogram bins join as extra key columns."""

    def __init__(self, df: DataFrame, sets: dict[str, list[str]], measures: list[str], bins: dict[str, tuple] | None = None):
        from ..session import ensure_checkpoint_dir

        self.measures = list(dict.fromkeys(measures))
        self.idx = {m: i for i, m in enumerate(self.measures)}
        bin_exprs, self.bin_col = [], {}
        for i, (c, (a, w, nbins)) in enumerate((bins or {}).items()):
            self.bin_col[c] = f"__bin{i}"
            x = K._finite(df, c)
            at = F.least(F.lit(nbins - 1), F.floor((x - F.lit(a)) / F.lit(w))).cast("int")
            bin_exprs.append(F.when(x.isNotNull(), at).alias(f"__bin{i}"))
            sets = dict(sets, **{f"b:{c}": [f"__bin{i}"]})
        self.sets = sets
        self.keys = list(dict.fromkeys(k for v in sets.values() for k in v))
        aggs = [F.count(F.lit(1)).alias("__n")]
        for m, i in self.idx.items():
            x = value_or_null(df, m)
            aggs += [F.sum(x).alias(f"__s{i}"), F.avg(x).alias(f"__a{i}"), F.count(x).alias(f"__c{i}")]
        base = df.select(*[q(c) for c in df.columns], *bin_exprs)
        unique = {tuple(v): list(v) for v in sets.values()}
        grouped = base.groupingSets(list(unique.values()), *[q(k) for k in self.keys]).agg(F.grouping_id().alias("__gid"), *aggs)
        ensure_checkpoint_dir(df.sparkSession)
        self.grouped = grouped.checkpoint(eager=True)
        self.count_groups()

    def membership(self, name: str) -> Column:
        """Rows of the grouped table that belong to grouping ``name`` (keys non-null)."""
        cols = self.sets[name]
        gid = sum(1 << (len(self.keys) - 1 - i) for i, k in enumerate(self.keys) if k not in cols)
        cond = F.col("__gid") == gid
        for c in cols:
            cond = cond & q(c).isNotNull()
        return cond

    def part(self, name: str) -> DataFrame:
        return self.grouped.where(self.membership(name))

    def sum(self, m: str) -> Column:
        return F.coalesce(F.col(f"__s{self.idx[m]}"), F.lit(0))

    def mean(self, m: str) -> Column:
        return F.col(f"__a{self.idx[m]}")

    def count(self, m: str) -> Column:
        return F.col(f"__c{self.idx[m]}")

    def count_groups(self) -> None:
        """Groups of every grouping; a grouped table of few rows becomes one
        partition, so that its many charts are one task each without shuffles."""
        names = list(self.sets)
        counts = [F.count(F.when(self.membership(n), 1)).alias(f"k{i}") for i, n in enumerate(names)]
        row = self.grouped.select(F.count(F.lit(1)).alias("all"), *counts).first()
        self._sizes = {n: row[f"k{i}"] for i, n in enumerate(names)}
        if row["all"] <= ONE_PARTITION_ROWS:
            self.grouped = self.grouped.coalesce(1)

    def sizes(self) -> dict[str, int]:
        return dict(self._sizes)

    def histogram(self, c: str) -> DataFrame:
        return self.part(f"b:{c}").select(F.col(self.bin_col[c]).alias("bin"), F.col("__n").alias("count"))


def _bin_specs(df: DataFrame, columns: list[str], bins: int = 20, ranges: dict | None = None) -> dict[str, tuple]:
    ranges = ranges if ranges is not None else K.value_ranges(df, columns)
    out = {}
    for c in columns:
        a, b = ranges[c]
        if a is not None:
            out[c] = (a, (b - a) / bins if b > a else 1.0, bins)
    return out


def _rolling_and_cumulative(ts: DataFrame, date: str, m: str, n: int):
    """K15 / K16 on a per-date series of ``n`` points (small, from one pass)."""
    roll = None
    if n >= 10:
        w = min(7, n // 3) or 3
        roll = prefix.rolling_mean(ts.select(date, m), m, w, [date], name=f"{m}_rolling", min_periods=1, n=n)
    cum = prefix.running(ts.select(date, m), {f"{m}_cumulative": ("sum", m)}, [date], keep_null_rows=False, n=n)
    return roll, cum


def sales_dashboard(df: DataFrame, date: str, sales: str, category: str | None = None, order_by=None) -> DataFrame:
    """Revenue trend, rolling and cumulative lines, sales by category,
    category over time, KPI -- all from one grouping-sets pass."""
    sets = {"all": [], "date": [date]}
    if category:
        sets.update({"cat": [category], "date_cat": [date, category]})
    one = OnePass(df, sets, [sales])
    ts = one.part("date").select(q(date), one.sum(sales).alias(sales))
    n_dates = one.part("date").count()
    roll, cum = _rolling_and_cumulative(ts, date, sales, n_dates)
    parts = [long("revenue_trend", ts, date, [sales])]
    if roll is not None:
        parts.append(long("revenue_rolling", roll, date, [f"{sales}_rolling"]))
    parts.append(long("revenue_cumulative", cum, date, [f"{sales}_cumulative"]))
    if category:
        parts.append(long("sales_by_category", one.part("cat").select(q(category), one.sum(sales).alias(sales)), category, [sales]))
        dc = one.part("date_cat").select(q(date), q(category), one.sum(sales).alias(sales))
        parts.append(long("stacked_trend", dc, date, [sales], series=category))
    parts.append(kpi_rows(df, [sales], order_by))
    return _union(parts)


def finance_dashboard(df: DataFrame, date: str, metrics: list[str], order_by=None) -> DataFrame:
    """All metrics per date, per-metric trends, correlation, distributions,
    KPI. Trends, histograms and KPIs share one grouping-sets pass; the
    correlation matrix is one more aggregate."""
    one = OnePass(df, {"all": [], "date": [date]}, metrics, bins=_bin_specs(df, metrics[:2]))
    ts = one.part("date").select(q(date), *[one.sum(m).alias(m) for m in metrics])
    parts = []
    if len(metrics) >= 2:
        parts.append(long("multi_trend", ts, date, metrics))
    for m in metrics[:3]:
        parts.append(long(f"{m}_trend", ts, date, [m]))
    if len(numeric_columns(df)) >= 2:
        from ..operators.profile import correlation_long

        parts.append(long("correlation", correlation_long(df), "col2", ["corr"], series="col1").select("chart", "series", "x", "y", "text"))
    for m in metrics[:2]:
        if m in one.bin_col:
            parts.append(long(f"dist_{m}", one.histogram(m), "bin", ["count"]))
    parts.append(kpi_rows(df, metrics, order_by))
    return _union(parts)


def hr_dashboard(df: DataFrame, dept: str, salary: str, order_by=None) -> DataFrame:
    """Mean / sum / count of salary by department (headcount = count), KPI;
    one grouping-sets pass."""
    one = OnePass(df, {"all": [], "dept": [dept]}, [salary])
    stats = one.part("dept").select(q(dept), one.mean(salary).alias("mean"), one.sum(salary).alias("sum"), one.count(salary).alias("count"))
    return _union([long("salary_by_dept", stats, dept, ["mean", "sum", "count"]), kpi_rows(df, [salary], order_by)])


def marketing_dashboard(df: DataFrame, channel: str, spend: str, conversion: str | None = None, order_by=None) -> DataFrame:
    """Spend by channel, conversion histogram, KPI; one grouping-sets pass."""
    measures = [spend] + ([conversion] if conversion else [])
    one = OnePass(df, {"all": [], "channel": [channel]}, measures, bins=_bin_specs(df, [conversion]) if conversion else None)
    parts = [long("spend_by_channel", one.part("channel").select(q(channel), one.sum(spend).alias(spend)), channel, [spend])]
    if conversion and conversion in one.bin_col:
        parts.append(long("conversion_hist", one.histogram(conversion), "bin", ["count"]))
    parts.append(kpi_rows(df, measures, order_by))
    return _union(parts)


def auto_dashboard(df: DataFrame, order_by=None, dashboard_type: str = "auto") -> DataFrame:
    """Typed dashboard when the columns allow, else the comprehensive set."""
    nums, cats, dates = numeric_columns(df), categorical_columns(df), date_columns(df)
    if dashboard_type == "sales" and dates and nums:
        return sales_dashboard(df, dates[0], nums[0], cats[0] if cats else None, order_by)
    if dashboard_type == "finance" and dates and len(nums) >= 2:
        return finance_dashboard(df, dates[0], nums[:3], order_by)
    if dashboard_type == "hr" and cats and nums:
        return hr_dashboard(df, cats[0], nums[0], order_by)
    if dashboard_type == "marketing" and cats and nums:
        return marketing_dashboard(df, cats[0], nums[0], nums[1] if len(nums) > 1 else None, order_by)
    return comprehensive_dashboard(df, nums, cats, dates, order_by)


#: Distinct values up to which a category joins the one-pass aggregate; a more
#: varied one is counted by itself, and only its top rows are kept.
ONE_PASS_VALUES = 100_000


def _scan(df: DataFrame, nums: list[str], cats: list[str]) -> dict:
    """One aggregate over the input: ranges and value counts of the numbers,
    missing values of all columns, about how many values each category has."""
    r = df.select(
        F.count(F.lit(1)).alias("n"),
        *[F.min(K._finite(df, c)).alias(f"mn{i}") for i, c in enumerate(nums)],
        *[F.max(K._finite(df, c)).alias(f"mx{i}") for i, c in enumerate(nums)],
        *[F.sum(is_missing(df, c).cast("long")).alias(f"z{i}") for i, c in enumerate(df.columns)],
        *[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cats)],
    ).first()
    return {
        "n": r["n"],
        "ranges": {c: (r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(nums)},
        "missing": {c: r[f"z{i}"] or 0 for i, c in enumerate(df.columns)},
        "about": {c: r[f"d{i}"] for i, c in enumerate(cats)},
    }


_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high", "outliers"]


def _most_missing(df: DataFrame, missing: dict[str, int], top: int) -> DataFrame:
    """Columns with missing values, most first, ties by name."""
    rows = sorted(((c, n) for c, n in missing.items() if n), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "column string, missing_count long")


def comprehensive_dashboard(df: DataFrame, nums, cats, dates, order_by=None, bins: int = 20) -> DataFrame:
    """K29 comprehensive set. Every group-by chart (value counts, sums and means
    by category, grouped and stacked bars, heatmap cells, treemap / sunburst
    leaves, donuts, date lines, histograms) comes from ONE ``GROUPING SETS``
    aggregate: one scan and one shuffle instead of one per chart. Its result (a
    row per group) is small and is checkpointed once; charts are filters of it.
    Box statistics (quantiles), the correlation, the KPI cards and the quality
    gauges (distinct rows) need their own passes; scatter data is the projection
    itself. A heatmap cell without rows is absent (its value is 0)."""
    info = _scan(df, nums[:4], cats[:4])
    wide = [c for c in cats[:4] if info["about"][c] > ONE_PASS_VALUES]
    dcol = dates[0] if dates else None
    sets: dict[str, list[str]] = {"all": []}
    sets.update({f"c:{c}": [c] for c in cats[:4] if c not in wide or c == cats[0]})
    if len(cats) >= 2:
        sets["pair"] = cats[:2]
    if dcol:
        sets["date"] = [dcol]
    one = OnePass(df, sets, nums[:4], bins=_bin_specs(df, nums[:4], bins, info["ranges"]))
    size = one.sizes()

    parts = [long("gauges", K.quality_gauges(df), "gauge", ["value"])]
    if len(nums) >= 2:
        from ..operators.profile import correlation_long

        parts.append(long("correlation_heatmap", correlation_long(df, columns=nums), "col2", ["corr"], series="col1"))
    for c in one.bin_col:
        parts.append(long(f"hist_{c}", one.histogram(c), "bin", ["count"]))
    if len(nums) >= 2:
        over = [one.histogram(c).select(F.lit(c).alias("column"), "bin", "count") for c in one.bin_col]
        parts += [long("overlaid_histograms", h, "bin", ["count"], series="column") for h in over]
    if nums[:3]:
        parts.append(long("box", K.box_stats(df, nums[:3]), "column", _BOX))
    if cats and nums:
        violins = K.box_stats(df, nums[:2], group_by=cats[0])
        parts += [long(f"violin_{m}", violins.where(F.col("column") == m), cats[0], _BOX) for m in nums[:2]]
    for c in cats[:4]:
        if c in wide:
            vc = K.value_count_bar(df, c)
        else:
            vc = one.part(f"c:{c}").select(q(c), F.col("__n").alias("count")).orderBy(F.col("count").desc(), q(c)).limit(12)
        parts.append(long(f"bar_{c}", vc, c, ["count"]))
    if cats and nums:
        cat = cats[0]
        for m in nums[:2]:
            for kind, value in (("sum", one.sum(m)), ("avg", one.mean(m))):
                by = one.part(f"c:{cat}").select(q(cat), value.alias(m)).orderBy(q(cat)).limit(12)
                parts.append(long(f"{kind}_{m}_by_{cat}", by, cat, [m]))
    if len(cats) >= 2:
        a, b, pair = cats[0], cats[1], one.part("pair")
        leaves = pair.select(q(a), q(b), F.col("__n").cast("double").alias("value"))
        parts.append(long("sunburst", leaves, a, ["value"], series=b))
        if nums:
            m = nums[0]
            cells = pair.select(q(a), q(b), one.sum(m).alias(m))
            bars = cells.orderBy(q(a), q(b)).limit(30)
            parts += [long(chart, bars, a, [m], series=b) for chart in ("grouped_bar", "stacked_bar")]
            parts += [long(chart, cells, a, [m], series=b) for chart in ("cat_heatmap", "treemap")]
    for c in cats[:3]:
        if c not in wide and size[f"c:{c}"] <= 8:
            parts.append(long(f"donut_{c}", one.part(f"c:{c}").select(q(c), F.col("__n").alias("count")), c, ["count"]))
    if dcol and nums:
        ts = one.part("date").select(q(dcol), *[one.sum(m).alias(m) for m in nums[:4]])
        for i, m in enumerate(nums[:3]):
            parts.append(long(f"line_{m}", ts.select(q(dcol), q(m)), dcol, [m]))
            roll, cum = _rolling_and_cumulative(ts, dcol, m, size["date"])
            if roll is not None:
                parts.append(long(f"rolling_{m}", roll, dcol, [f"{m}_rolling"]))
            if i < 2:
                parts.append(long(f"cumulative_{m}", cum, dcol, [f"{m}_cumulative"]))
        if len(nums) >= 2:
            parts.append(long("multi_line", ts, dcol, nums[:4]))
    color = cats[0] if cats else None
    if len(nums) >= 2:
        parts.append(long("scatter_xy", K.scatter(df, nums[0], nums[1], color), nums[0], [nums[1]], series=color))
    if len(nums) >= 3:
        head = K.bubble(df, *nums[:3], order_by or df.columns, color)
        parts.append(long("bubble_xy", head, nums[0], nums[1:3]))
    if any(info["missing"].values()):
        parts.append(long("missing_values", _most_missing(df, info["missing"], 10), "column", ["missing_count"]))
    if nums:
        parts.append(kpi_rows(df, nums[:4], order_by))
    return _union(parts)


def report_chart_index(df: DataFrame) -> DataFrame:
    """Which charts the report would contain, with section and the number
    of data rows of each chart dataset. Two passes over the input (ranges and
    missing values; one grouping-sets aggregate) and one over its small result."""
    nums, cats, dates = numeric_columns(df), categorical_columns(df), date_columns(df)
    info = _scan(df, nums[:6], cats[:5])
    sets: dict[str, list[str]] = {"all": []}
    sets.update({f"c:{c}": [c] for c in cats[:5]})
    sets.update({f"d:{d}": [d] for d in dates[:2]})
    if len(cats) >= 2:
        sets["pair"] = cats[:2]
    one = OnePass(df, sets, nums[:3], bins=_bin_specs(df, nums[:6], 20, info["ranges"]))
    size, n = one.sizes(), info["n"]
    rows: list[tuple] = []

    def add(section: str, *charts: tuple[str, int]) -> None:
        rows.extend((name, section, int(k)) for name, k in charts)

    missing = sum(1 for v in info["missing"].values() if v)
    add("quality", ("quality_completeness", 1), ("quality_duplicates", 1))
    if missing:
        add("quality", *[(f"missing_values_{k}", min(15, missing)) for k in ("bar", "hbar")])
        add("quality", ("missing_pattern_heatmap", min(50, n) * len(df.columns)))
    add("distribution", *[(f"hist_{c}", size.get(f"b:{c}", 0)) for c in nums[:6]])
    add("distribution", *[(f"percentile_{c}", 7) for c in nums[:3]])
    if len(nums) >= 2:
        add("distribution", ("overlaid_histograms", sum(size.get(f"b:{c}", 0) for c in nums[:4])))
    add("distribution", *[(f"box_{c}", 1) for c in nums[:4]])
    if cats and nums:
        cat = cats[0]
        filled = one.part(f"c:{cat}").select(*[F.count(F.when(one.count(m) > 0, 1)).alias(m) for m in nums[:3]]).first()
        add("distribution", *[(f"violin_{m}", filled[m]) for m in nums[:3]])
        groups = size[f"c:{cat}"]
        add("bars", *[(f"bar_{k}_{m}_by_{cat}", min(15, groups)) for m in nums[:3] for k in ("sum", "mean")])
        add("bars", ("paired_bar_sum_mean", min(12, groups)))
        add("lines", *[(f"line_by_{cat}_{m}", groups) for m in nums[:2]])
    for c in cats[:5]:
        add("bars", (f"bar_{c}", min(12, size[f"c:{c}"])), (f"hbar_{c}", min(12, size[f"c:{c}"])))
    for d in dates[:2]:
        points = size[f"d:{d}"]
        for m in nums[:3]:
            add("lines", (f"line_{d}_{m}", points), (f"cumulative_{d}_{m}", points))
            if points >= 10:
                add("lines", (f"rolling_{d}_{m}", points))
        if len(nums) >= 2:
            add("lines", (f"multiline_{d}", points))
    if len(nums) >= 2:
        add("heatmaps", ("correlation_heatmap", len(nums) ** 2))
        add("scatter", ("scatter_xy", n))
    if len(nums) >= 3:
        add("scatter", ("scatter_xz", n), ("bubble_xy", min(200, n)))
    if len(cats) >= 2:
        pairs, both = size["pair"], f"{cats[0]}_{cats[1]}"
        add("heatmaps", *[(f"heatmap_{both}_{m}", pairs) for m in nums[:2]], (f"heatmap_counts_{both}", pairs))
        add("hierarchy", ("sunburst", pairs))
        if nums:
            add("bars", ("grouped_bar", min(30, pairs)), ("stacked_bar", min(30, pairs)))
            add("hierarchy", ("treemap", pairs))
    add("composition", *[(f"donut_{c}", size[f"c:{c}"]) for c in cats[:3] if size[f"c:{c}"] <= 8])
    return df.sparkSession.createDataFrame(rows, "chart string, section string, rows long")
