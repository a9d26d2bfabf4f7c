"""Cleaning operators (duplicates, missing values, outliers, text, names, types)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DATE_TYPES, NUMERIC_TYPES, categorical_columns, is_missing, numeric_columns, value_or_null
from ..functions.numeric import number_like
from ..functions.text import strip_ws
from . import prefix
from .quantiles import column_quantiles

# Formats tried, in order, when a text column is read as dates.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
]


def q(name: str):
    """Column reference that survives dots and spaces in names."""
    return F.col(f"`{name}`")


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """C01. Whole rows: ``distinct``. With ``subset``: the first row by ``order_by``
    per key, as an aggregate (``min_by``) so a hot key is combined map-side
    instead of sorted in one task."""
    if not subset:
        return df.dropDuplicates()
    if not order_by:
        return df.dropDuplicates(subset)
    others = [c for c in df.columns if c not in subset]
    if not others:
        return df.dropDuplicates(subset)
    row = F.struct(*[q(c) for c in others])
    key = F.struct(*[q(c) for c in order_by])
    picked = df.groupBy(*[q(c) for c in subset]).agg(F.min_by(row, key).alias("__r"))
    return picked.select(*subset, *[F.col("__r").getField(c).alias(c) for c in others]).select(*df.columns)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """One pass: null count of every column."""
    cols = columns or df.columns
    if not cols:
        return {}
    row = df.select(*[F.sum(is_missing(df, c).cast("long")).alias(c) for c in cols]).first()
    return {c: int(row[c] or 0) for c in cols}


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, smallest on ties (pandas ``mode().iloc[0]``).

    Distributed: unpivot to (column, value), count with partial aggregation,
    then max count per column and min value among the maxima."""
    if not columns:
        return {}
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value_or_null(df, c).cast("string").alias("v")) for c in columns])).alias("p")
    ).select("p.c", "p.v").where(F.col("v").isNotNull())
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # highest count first, then the smallest value by its own type (numbers as
    # numbers, not as text): one aggregate, no join
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    number = F.when(~F.col("c").isin(texts) if texts else F.lit(True), F.col("v").try_cast("double"))
    whole = F.when(~F.col("c").isin(texts) if texts else F.lit(True), F.col("v").try_cast("decimal(38,0)"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), number, whole, F.col("v"))).alias("v")).collect()
    found = {r["c"]: r["v"] for r in best}
    out = {}
    for c in columns:
        v = found.get(c)
        if v is not None and not isinstance(df.schema[c].dataType, T.StringType):
            v = df.sparkSession.createDataFrame([(v,)], "v string").select(F.col("v").cast(df.schema[c].dataType)).first()[0]
        out[c] = v
    return out


def handle_missing_values(
    df: DataFrame,
    strategy: str = "auto",
    fill_values: dict | None = None,
    order_by: list[str] | None = None,
    parse_dates: bool = False,
) -> DataFrame:
    """C02-C04. ``auto``: numeric -> median, date -> forward fill along
    ``order_by``, other -> mode (or ``"Unknown"``). ``drop``: rows with any null.
    ``fill``: constants per column.

    ``parse_dates`` also applies C09 afterwards, deciding it in the same
    statistics pass: filling only adds copies of existing values (or
    "Unknown" to an all-null column), so which text columns parse completely
    does not change."""
    if strategy == "drop":
        return df.na.drop(how="any")
    if strategy == "fill":
        return df.na.fill(fill_values) if fill_values else df
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    # one pass: null count of every column, and n / min / max of numeric ones
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in df.columns if isinstance(types[c], NUMERIC_TYPES)]
    text = [c for c in df.columns if isinstance(types[c], T.StringType)] if parse_dates else []
    row = df.select(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(is_missing(df, c).cast("long")).alias(f"z{i}") for i, c in enumerate(df.columns)],
        *[F.min(q(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(df.columns) if c in numeric],
        *[F.max(q(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(df.columns) if c in numeric],
        *[F.count(q(c)).alias(f"tn{i}") for i, c in enumerate(df.columns) if c in text],
        *[F.count(parse_timestamp(c)).alias(f"tp{i}") for i, c in enumerate(df.columns) if c in text],
    ).first()
    idx = {c: i for i, c in enumerate(df.columns)}
    parse_ok = {c for c in text if row[f"tn{idx[c]}"] > 0 and row[f"tn{idx[c]}"] == row[f"tp{idx[c]}"]}

    def parsed(frame: DataFrame) -> DataFrame:
        if not parse_ok:
            return frame
        return frame.select(*[(parse_timestamp(c) if c in parse_ok else q(c)).alias(c) for c in frame.columns])

    nulls = {c: int(row[f"z{i}"] or 0) for c, i in idx.items()}
    todo = [c for c, n in nulls.items() if n > 0]
    if not todo:
        return parsed(df)
    num = [c for c in todo if c in numeric]
    dates = [c for c in todo if isinstance(types[c], DATE_TYPES)]
    other = [c for c in todo if c not in num and c not in dates]
    stats = {(c,): (row["__rows"] - nulls[c], row[f"lo{idx[c]}"], row[f"hi{idx[c]}"]) for c in num}
    medians = column_quantiles(df, num, [0.5], stats=stats) if num else {}
    modes = column_modes(df, other)
    exprs = {}
    for c in num:
        m = medians[c][0]
        if m is not None:
            # pandas holds an integer column with gaps as float64
            exprs[c] = F.coalesce(value_or_null(df, c).cast("double"), F.lit(m))
    for c in other:
        v = modes.get(c)
        if v is None:
            v = "Unknown" if isinstance(types[c], T.StringType) else None
        if v is not None:
            exprs[c] = F.coalesce(q(c), F.lit(v).cast(types[c]))
    out = df.select(*[exprs.get(c, q(c)).alias(c) for c in df.columns])
    if dates:
        if not order_by:
            raise ValueError("forward fill of date columns needs order_by")
        specs = {c: ("last", c) for c in dates}
        out = prefix.running(out, specs, order_by, n=row["__rows"]).select(*df.columns)
    return parsed(out)


def remove_empty_rows(df: DataFrame, how: str = "all") -> DataFrame:
    """C05."""
    return df.na.drop(how=how)


def remove_outliers_iqr(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, independent: bool = False
) -> DataFrame:
    """C06. Keep rows with Q1 - m*IQR <= x <= Q3 + m*IQR (rows with null x go).

    Default is the reference's sequential rule: each column's quartiles come
    from the rows that survived the previous columns (one quantile job per
    column). ``independent=True`` takes all quartiles from the input in one job.
    """
    cols = columns or numeric_columns(df)
    if independent:
        qs = column_quantiles(df, cols, [0.25, 0.75])
        cond = F.lit(True)
        for c in cols:
            q1, q3 = qs[c]
            if q1 is None:
                return df.limit(0)
            iqr = q3 - q1
            cond = cond & q(c).between(q1 - multiplier * iqr, q3 + multiplier * iqr)
        return df.where(cond)
    out = df
    for c in cols:
        q1, q3 = column_quantiles(out, [c], [0.25, 0.75])[c]
        if q1 is None:
            return out.limit(0)
        iqr = q3 - q1
        out = out.where(q(c).between(q1 - multiplier * iqr, q3 + multiplier * iqr))
    return out


def standardize_text_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip all outer whitespace and lower-case (null stays null)."""
    cols = set(columns or categorical_columns(df))
    return df.select(*[(F.lower(strip_ws(q(c))) if c in cols else q(c)).alias(c) for c in df.columns])


# Fixed value: cleaned names must equal the reference's, so the pattern is the same.
def clean_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", str(name)).strip("_").lower()


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2`` ... in order of appearance."""
    seen: dict[str, int] = {}
    out = []
    taken = set(names)
    for n in names:
        if n in seen:
            k = seen[n] + 1
            while f"{n}_{k}" in taken:
                k += 1
            seen[n] = k
            out.append(f"{n}_{k}")
            taken.add(f"{n}_{k}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    """C08."""
    return df.toDF(*dedupe_names([clean_name(c) for c in df.columns]))


# Shape of the text each format can parse (a format never parses text of
# another shape). Parsing tries only the formats of the matching shape, in
# DATE_FORMATS order, so the first success is the same as trying them all,
# without the costly failing attempts.
_D = r"[+-]?[0-9]+"
DATE_SHAPES = {
    "yyyy-MM-dd HH:mm:ss.SSSSSS": rf"^{_D}-[0-9]+-[0-9]+ [0-9]+:[0-9]+:[0-9]+\.[0-9]+$",
    "yyyy-MM-dd HH:mm:ss": rf"^{_D}-[0-9]+-[0-9]+ [0-9]+:[0-9]+:[0-9]+$",
    "yyyy-MM-dd'T'HH:mm:ss": rf"^{_D}-[0-9]+-[0-9]+T[0-9]+:[0-9]+:[0-9]+$",
    "yyyy-MM-dd HH:mm": rf"^{_D}-[0-9]+-[0-9]+ [0-9]+:[0-9]+$",
    "yyyy-MM-dd": rf"^{_D}-[0-9]+-[0-9]+$",
    "yyyy/MM/dd": rf"^{_D}/[0-9]+/[0-9]+$",
    "MM/dd/yyyy": rf"^{_D}/[0-9]+/[0-9]+$",
    "dd.MM.yyyy": rf"^{_D}\.[0-9]+\.[0-9]+$",
}


def parse_timestamp(c) -> "F.Column":
    """First format of ``DATE_FORMATS`` that parses, else null."""
    c = q(c) if isinstance(c, str) else c
    s = strip_ws(c)
    by_shape: dict[str, list[str]] = {}
    for fmt in DATE_FORMATS:
        by_shape.setdefault(DATE_SHAPES[fmt], []).append(fmt)
    out = None
    for shape, fmts in by_shape.items():
        parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts]) if len(fmts) > 1 else F.try_to_timestamp(s, F.lit(fmts[0]))
        out = F.when(s.rlike(shape), parsed) if out is None else out.when(s.rlike(shape), parsed)
    return out.cast("timestamp_ntz")


def autoparse_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A text column becomes a timestamp only if every non-null value parses.

    All columns are decided by one aggregate (``count(c)`` vs ``count(parsed)``)."""
    cols = columns or categorical_columns(df)
    if not cols:
        return df
    row = df.select(
        *[F.count(q(c)).alias("n_" + c) for c in cols], *[F.count(parse_timestamp(c)).alias("p_" + c) for c in cols]
    ).first()
    ok = {c for c in cols if row["n_" + c] > 0 and row["n_" + c] == row["p_" + c]}
    return df.select(*[(parse_timestamp(c) if c in ok else q(c)).alias(c) for c in df.columns])


def auto_clean(df: DataFrame, order_by: list[str] | None = None, materialize: bool = True) -> tuple[DataFrame, list[str]]:
    """Names, duplicates, empty rows, auto fill, date parsing.

    The fill and parse steps take several statistics passes over the
    de-duplicated rows; with ``materialize`` those rows are written once by a
    reliable ``checkpoint()`` (shared checkpoint folder) instead of repeating
    the de-duplication shuffle for every pass."""
    df = remove_empty_rows(remove_duplicates(clean_column_names(df)))
    if materialize:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    if order_by:
        order_by = [clean_name(c) for c in order_by]
    # fills and the date-parse decision share one statistics pass
    df = handle_missing_values(df, "auto", order_by=order_by, parse_dates=True)
    return df, list(CLEAN_STEPS)


# The step names must equal the reference's.
CLEAN_STEPS = [
    "Standardized column names", "Removed duplicates", "Removed empty rows", "Auto-filled missing values", "Parsed date columns",
]


def auto_clean_steps(df: DataFrame) -> DataFrame:
    """C10 report: (step_no, step, rows_before, rows_after). Only removing
    duplicates and empty rows changes the number of rows; all three counts come
    from one grouping of the input (an empty row is one group)."""
    named = clean_column_names(df)
    filled = F.greatest(F.lit(0), *[q(c).isNotNull().cast("int") for c in named.columns])
    groups = named.groupBy(*[q(c) for c in named.columns]).agg(F.count(F.lit(1)).alias("__n")).withColumn("__filled", filled)
    counts = groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum("__filled"), F.lit(0)).cast("long").alias("kept"),
    )
    before = ["rows", "rows", "distinct_rows", "kept", "kept"]
    after = ["rows", "distinct_rows", "kept", "kept", "kept"]
    steps = [
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), F.col(b).alias("rows_before"), F.col(a).alias("rows_after"))
        for i, (s, b, a) in enumerate(zip(CLEAN_STEPS, before, after))
    ]
    return counts.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def numeric_text(c) -> "F.Column":
    """Text to number after removing thousands separators and outer blanks."""
    c = q(c) if isinstance(c, str) else c
    t = strip_ws(F.regexp_replace(c.cast("string"), ",", ""))
    return F.when(number_like(t), t.try_cast("double"))


def coerce_numeric_majority(df: DataFrame) -> DataFrame:
    """C11 (extracted-table clean-up): drop all-null rows, snake-case headers,
    then turn a column numeric when more than half of the rows convert."""
    df = df.na.drop(how="all")
    names = dedupe_names([str(c).strip().lower().replace(" ", "_") for c in df.columns])
    df = df.toDF(*names)
    cols = [c for c in df.columns if not isinstance(df.schema[c].dataType, NUMERIC_TYPES)]
    if not cols:
        return df
    row = df.select(F.count(F.lit(1)).alias("__n"), *[F.count(numeric_text(c)).alias(c) for c in cols]).first()
    n = row["__n"]
    ok = {c for c in cols if row[c] > n * 0.5}
    return df.select(*[(numeric_text(c) if c in ok else q(c)).alias(c) for c in df.columns])
