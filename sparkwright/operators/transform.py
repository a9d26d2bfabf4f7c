"""Transformation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import categorical_columns, numeric_columns, value_or_null
from ..functions.numeric import number_like
from ..functions.text import strip_ws
from . import prefix
from .cleaning import parse_timestamp, q
from .quantiles import grouped_quantiles
from ..session import ensure_checkpoint_dir


def normalize_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Z-score with sample std, only where std > 0 (one aggregate job)."""
    cols = columns or numeric_columns(df)
    if not cols:
        return df
    row = df.select(
        *[F.avg(value_or_null(df, c)).alias("m_" + c) for c in cols],
        *[F.stddev_samp(value_or_null(df, c)).alias("s_" + c) for c in cols],
    ).first()
    out = []
    for c in df.columns:
        s = row["s_" + c] if c in cols else None
        if s is not None and s > 0:
            out.append(((value_or_null(df, c) - F.lit(row["m_" + c])) / F.lit(s)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def distinct_values_bounded(df: DataFrame, columns: list[str], limit: int) -> dict[str, list | None]:
    """Sorted distinct non-null values of each column, or None when a column has
    more than ``limit`` of them. Two small jobs; never gathers an unbounded set."""
    if not columns:
        return {}
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value_or_null(df, c).cast("string").alias("v")) for c in columns])).alias("p")
    ).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
    n = {r["c"]: r["count"] for r in long.groupBy("c").count().collect()}
    small = [c for c in columns if n.get(c, 0) <= limit]
    out: dict[str, list | None] = {c: None for c in columns}
    for c in small:
        out[c] = []
    if small:
        for r in long.where(F.col("c").isin(small)).collect():
            out[r["c"]].append(r["v"])
    for c in small:
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            out[c] = sorted(out[c])
        else:
            conv = df.sparkSession.createDataFrame([(v,) for v in out[c]] or [("x",)], "v string")
            vals = [r[0] for r in conv.select(F.col("v").cast(dt)).collect()] if out[c] else []
            out[c] = sorted(vals)
    return out


def one_hot_encode(df: DataFrame, columns: list[str] | None = None, max_categories: int = 10) -> DataFrame:
    """``<col>_<value>`` boolean columns in sorted value order, source dropped;
    null rows are all false; columns with more than ``max_categories`` values stay."""
    cols = columns or categorical_columns(df)
    values = distinct_values_bounded(df, cols, max_categories)
    keep = [q(c) for c in df.columns if not (c in cols and values[c] is not None)]
    dummies = []
    for c in cols:
        if values[c] is None:
            continue
        for v in values[c]:
            dummies.append(F.coalesce(q(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
    return df.select(*keep, *dummies)


def parse_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Coerce text to timestamps, unparseable -> null."""
    cols = set(columns or categorical_columns(df))
    return df.select(*[(parse_timestamp(c) if c in cols else q(c)).alias(c) for c in df.columns])


def convert_dtypes(df: DataFrame) -> DataFrame:
    """A text column becomes numeric only if every non-null value converts
    (bigint when all integral and no nulls, else double)."""
    cols = categorical_columns(df)
    if not cols:
        return df
    num = {c: F.when(number_like(strip_ws(q(c))), strip_ws(q(c)).try_cast("double")) for c in cols}
    integral = {c: F.when(strip_ws(q(c)).rlike("[0-9]"), strip_ws(q(c)).try_cast("bigint")) for c in cols}
    row = df.select(
        F.count(F.lit(1)).alias("__n"),
        *[F.count(q(c)).alias("n_" + c) for c in cols],
        *[F.count(num[c]).alias("d_" + c) for c in cols],
        *[F.count(integral[c]).alias("i_" + c) for c in cols],
    ).first()
    out = []
    for c in df.columns:
        if c in num and row["n_" + c] > 0 and row["d_" + c] == row["n_" + c]:
            if row["i_" + c] == row["n_" + c] and row["n_" + c] == row["__n"]:
                out.append(integral[c].alias(c))
            else:
                out.append(num[c].alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def date_parts(c: Column, prefix_name: str, weekday_flag: bool = True) -> list[Column]:
    parts = [
        F.year(c).alias(f"{prefix_name}_year"),
        F.month(c).alias(f"{prefix_name}_month"),
        F.dayofmonth(c).alias(f"{prefix_name}_day"),
        F.quarter(c).alias(f"{prefix_name}_quarter"),
        F.weekday(c).alias(f"{prefix_name}_dayofweek"),
    ]
    if weekday_flag:
        parts.append((F.weekday(c) < 5).cast("int").alias(f"{prefix_name}_weekday"))
    return parts


def add_date_features(df: DataFrame, date_column: str) -> DataFrame:
    """Year, month, day, quarter, dayofweek (Monday=0), weekday flag."""
    dt = df.schema[date_column].dataType
    c = q(date_column) if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) else parse_timestamp(date_column)
    base = df.withColumn(date_column, c)
    return base.select("*", *date_parts(q(date_column), date_column))


_AGG = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.countDistinct,
}


def aggregate(
    df: DataFrame, group_by: list[str], aggregations: dict[str, str], order_by: list[str] | None = None
) -> DataFrame:
    """Pandas ``groupby(keys).agg({col: func})``: null keys dropped, sorted
    by key, output columns keep their names. ``median`` uses exact distributed
    quantiles; ``first`` / ``last`` (first / last non-null) need ``order_by``."""
    base = df.where(reduce(lambda a, b: a & b, [q(g).isNotNull() for g in group_by]))
    exprs, medians = [], []
    for c, fn in aggregations.items():
        if fn in _AGG:
            exprs.append(_AGG[fn](value_or_null(df, c)).alias(c))
        elif fn in ("first", "last"):
            if not order_by:
                raise ValueError(f"{fn} needs order_by")
            key = F.when(value_or_null(df, c).isNotNull(), F.struct(*[q(o) for o in order_by]))
            exprs.append((F.min_by if fn == "first" else F.max_by)(q(c), key).alias(c))
        elif fn == "median":
            medians.append(c)
        else:
            raise ValueError(f"unknown aggregation {fn!r}")
    out = base.groupBy(*[q(g) for g in group_by]).agg(*exprs) if exprs else base.select(*group_by).distinct()
    if medians:
        per = grouped_quantiles(base, medians, [0.5], list(group_by))
        med = per.groupBy(*[q(g) for g in group_by]).agg(
            *[F.max(F.when(F.col("__series") == m, F.col("q")[0])).alias(m) for m in medians]
        )
        out = out.join(med, on=group_by, how="left")
    cols = list(group_by) + [c for c in aggregations]
    return out.select(*cols).orderBy(*group_by)


#: Columns a wide result may have; beyond it the long form is the answer.
MAX_WIDE = 2000


def pivot_long(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "mean") -> DataFrame:
    """The cells of the pivot table, one row each: (index, ``column`` as text,
    ``value``), for any number of columns. Null keys are dropped; a cell whose
    values are all missing is none for mean / min / max, and 0 for sum / count."""
    x = value_or_null(df, values)
    base = df.where(q(index).isNotNull() & q(columns).isNotNull())
    if aggfunc not in ("sum", "count"):
        base = base.where(x.isNotNull())
    cell = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[aggfunc](x)
    if aggfunc == "sum":
        cell = F.coalesce(cell, F.lit(0))
    return base.groupBy(q(index), q(columns).cast("string").alias("column")).agg(cell.alias("value"))


def widen(cells: DataFrame, index: str, fill=None, max_columns: int = MAX_WIDE) -> DataFrame:
    """Cells (index, column, value) as a wide table sorted by ``index``. The
    columns are counted first; more than ``max_columns`` raise."""
    n = cells.agg(F.countDistinct("column")).first()[0]
    if n > max_columns:
        raise ValueError(f"{n} columns exceed max_columns={max_columns}; use the long form")
    names = [r[0] for r in cells.select("column").distinct().orderBy("column").collect()]
    wide = cells.groupBy(q(index)).pivot("column", names).agg(F.first("value"))
    if fill is not None:
        wide = wide.select(q(index), *[F.coalesce(q(c), F.lit(fill)).alias(c) for c in names])
    return wide.orderBy(q(index))


def pivot(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "mean", max_columns: int = MAX_WIDE) -> DataFrame:
    """Pivot table; cells without rows are null, rows and columns without a
    cell are dropped. :func:`pivot_long` has no limit of columns."""
    return widen(pivot_long(df, index, columns, values, aggfunc), index, max_columns=max_columns)


def melt(df: DataFrame, id_vars: list[str], value_vars: list[str] | None = None) -> DataFrame:
    """Long form ``(id_vars..., variable, value)``; values cast to a common type."""
    value_vars = value_vars or [c for c in df.columns if c not in id_vars]
    types = {df.schema[c].dataType for c in value_vars}
    if len(types) > 1:
        num = all(isinstance(t, (T.NumericType)) for t in types)
        target = "double" if num else "string"
        df = df.select(*[q(c) for c in id_vars], *[q(c).cast(target).alias(c) for c in value_vars])
    return df.unpivot(id_vars, value_vars, "variable", "value")


def sort_values(df: DataFrame, by: list[str], ascending: bool = True) -> DataFrame:
    """Nulls last both ways."""
    return df.orderBy(*[(q(b).asc_nulls_last() if ascending else q(b).desc_nulls_last()) for b in by])


def _rank_type(dt: T.DataType) -> str:
    """Type that values are compared in: wide enough to keep each apart."""
    if isinstance(dt, T.DecimalType):
        return dt.simpleString()
    return "bigint" if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "double"


#: Distinct values of one column up to which its rank table is broadcast.
RANK_BROADCAST_ROWS = 100_000


def average_ranks(
    df: DataFrame, columns: list[str], ascending: bool = False, names: dict[str, str] | None = None, **kw
) -> DataFrame:
    """Pandas ``rank(ascending=...)`` (ties share their mean rank, null stays
    null) for several columns in one pass per type class: count per (column,
    value), a running count per column along the values (two-phase prefix, no
    single-partition window), then one join back per column; a rank table of
    few values, by its count, is broadcast. Values keep their own type."""
    names = names or {c: f"{c}_rank" for c in columns}
    classes: dict[str, list[str]] = {}
    for c in columns:
        classes.setdefault(_rank_type(df.schema[c].dataType), []).append(c)
    out = df
    ensure_checkpoint_dir(df.sparkSession)
    for kind, own in classes.items():
        long = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value_or_null(df, c).cast(kind).alias("v")) for c in own])).alias("p")
        ).select(F.col("p.c").alias("__c"), F.col("p.v").alias("__v")).where(F.col("__v").isNotNull())
        counts = long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__n"))
        falling = F.bitwise_not("__v") if kind == "bigint" else -F.col("__v")  # -v - 1: no overflow
        counts = counts.withColumn("__o", F.col("__v") if ascending else falling)
        # the count table feeds several passes (bounds, windows, carries): write it once
        counts = counts.checkpoint(eager=True)
        values = {r["__c"]: r["count"] for r in counts.groupBy("__c").count().collect()}
        cum = prefix.running(counts, {"__cum": ("sum", "__n")}, ["__o"], group_by=["__c"], n=sum(values.values()), **kw)
        ranks = cum.select("__c", "__v", (F.col("__cum") - F.col("__n") + (F.col("__n") + 1) / 2.0).alias("__r"))
        for c in own:
            r = ranks.where(F.col("__c") == c).select(F.col("__v").alias("__k"), F.col("__r").alias(names[c]))
            if values.get(c, 0) <= RANK_BROADCAST_ROWS:
                r = F.broadcast(r)
            out = out.join(r, value_or_null(df, c).cast(kind) == F.col("__k"), "left").drop("__k")
    order = [c for c in columns]
    return out.select(*[q(c) for c in df.columns if c not in names.values()], *[q(names[c]) for c in order])


def rank_average(df: DataFrame, column: str, name: str | None = None, ascending: bool = False, **kw) -> DataFrame:
    return average_ranks(df, [column], ascending, {column: name or f"{column}_rank"}, **kw)


def rank_columns(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    return average_ranks(df, columns, **kw)


def bin_edges(df: DataFrame, column: str, bins: int) -> list[float] | None:
    """``bins + 1`` edges of pandas ``cut`` over the finite values: equal steps
    from min to max, the lowest lowered by 0.1 % of the range; a constant column
    is widened by 0.1 % of its value at both ends."""
    x = value_or_null(df, column).cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    row = df.select(F.min(x).alias("a"), F.max(x).alias("b")).first()
    a, b = row["a"], row["b"]
    if a is None:
        return None
    flat = a == b
    if flat:
        a, b = a - (0.001 * abs(a) or 0.001), b + (0.001 * abs(b) or 0.001)
    step = (b - a) / bins
    edges = [a + i * step for i in range(bins)] + [b]
    if not flat:
        edges[0] = a - (b - a) * 0.001
    return edges


def create_bins(
    df: DataFrame, column: str, bins: int, labels: list[str] | None = None, name: str | None = None
) -> DataFrame:
    """Right-closed equal-width bins: a value belongs to the bin whose edges
    hold it (compared with the edges themselves). Missing and infinite values
    have no bin.

    Adds ``<col>_binned`` (label, or ``(lower, upper]`` text) and
    ``<col>_bin`` = struct(bin_index, lower, upper)."""
    name = name or f"{column}_binned"
    if labels and len(labels) != bins:
        raise ValueError("labels must have one entry per bin")
    edges = bin_edges(df, column, bins)
    if edges is None:
        nothing = F.lit(None).cast("struct<bin_index:int,lower:double,upper:double>")
        return df.select("*", F.lit(None).cast("string").alias(name), nothing.alias(f"{column}_bin"))
    x = value_or_null(df, column).cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    table = F.array(*[F.lit(e) for e in edges])
    idx = F.size(F.filter(table, lambda e: e < x))
    lower, upper = F.element_at(table, idx), F.element_at(table, idx + 1)
    label = F.element_at(F.array(*[F.lit(l) for l in labels]), idx) if labels else F.format_string("(%.3f, %.3f]", lower, upper)
    info = F.struct(idx.alias("bin_index"), lower.alias("lower"), upper.alias("upper"))
    return df.select("*", F.when(x.isNotNull(), label).alias(name), F.when(x.isNotNull(), info).alias(f"{column}_bin"))


# Operation name -> function(df, **params)
REGISTRY = {
    "normalize_numeric": normalize_numeric,
    "one_hot_encode": one_hot_encode,
    "parse_dates": parse_dates,
    "convert_dtypes": convert_dtypes,
    "add_date_features": add_date_features,
    "aggregate": aggregate,
    "pivot": pivot,
    "melt": melt,
    "sort_values": sort_values,
    "rank_columns": rank_columns,
    "create_bins": create_bins,
}


def apply_transformations(df: DataFrame, transformations: list[dict] | None) -> DataFrame:
    """Apply ``[{"operation": name, **params}]`` in order; default convert_dtypes.
    Unknown names raise (the reference skips them silently)."""
    if not transformations:
        return convert_dtypes(df)
    for t in transformations:
        params = {k: v for k, v in t.items() if k != "operation"}
        op = t.get("operation")
        if op not in REGISTRY:
            raise ValueError(f"unknown transformation {op!r}")
        df = df.transform(lambda d, f=REGISTRY[op], p=params: f(d, **p))
    return df
