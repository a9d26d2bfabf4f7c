"""Validation and data-quality checks (V01-V06). Results are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import is_missing, numeric_columns, value_or_null
from ..functions.stats import pct
from .cleaning import q
from .quantiles import column_quantiles
from .topk import top_k_per_group


def check_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Every member of a duplicated group counts (pandas ``keep=False``).
    One row: has_duplicates, duplicate_count, duplicate_percentage. Lazy; the
    group count is partially aggregated, so hot keys combine map-side."""
    cols = subset or df.columns
    g = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    agg = g.agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).cast("long").alias("duplicate_count"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
    )
    return agg.select(
        (F.col("duplicate_count") > 0).alias("has_duplicates"),
        "duplicate_count",
        pct(F.col("duplicate_count"), F.col("rows")).alias("duplicate_percentage"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing_count) for every column, in one pass (lazy)."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, missing_count long")
    counts = df.select(
        *[F.sum(is_missing(df, c).cast("long")).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("missing_count")) for i, c in enumerate(df.columns)]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.missing_count")


def check_missing_values(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary row: total_missing, columns_with_missing; per-column counts > 0)."""
    per = missing_by_column(df)
    summary = per.agg(
        F.coalesce(F.sum("missing_count"), F.lit(0)).cast("long").alias("total_missing"),
        F.count(F.when(F.col("missing_count") > 0, 1)).cast("long").alias("columns_with_missing"),
    )
    return summary, per.where(F.col("missing_count") > 0)


def check_outliers_zscore(df: DataFrame, threshold: float = 3.0, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column, rows with |x - mean| / std > threshold (sample std);
    only columns with at least one. Lazy: moments (one row) and counts run in
    the same query when the result is used."""
    cols = columns or numeric_columns(df)
    schema = "column string, count long, percentage double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    # lazy: the one-row moments are broadcast into the counting pass
    m = df.select(
        *[F.avg(value_or_null(df, c)).alias("__m" + str(i)) for i, c in enumerate(cols)],
        *[F.stddev_samp(value_or_null(df, c)).alias("__s" + str(i)) for i, c in enumerate(cols)],
    )
    exprs = []
    for i, c in enumerate(cols):
        sd = F.col("__s" + str(i))
        cond = (sd > 0) & (F.abs((value_or_null(df, c) - F.col("__m" + str(i))) / sd) > F.lit(threshold))
        exprs.append(F.count(F.when(cond, 1)).alias("o" + str(i)))
    df = df.crossJoin(F.broadcast(m))
    counted = df.select(F.count(F.lit(1)).alias("__n"), *exprs)
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col("o" + str(i)).cast("long").alias("count")) for i, c in enumerate(cols)
    ]
    out = counted.select("__n", F.explode(F.array(*pairs)).alias("p")).select("__n", "p.*")
    return out.where(F.col("count") > 0).select(
        "column", "count", F.round(F.col("count") / F.col("__n") * 100, 2).alias("percentage")
    )


def check_schema_compliance(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Issues (column, issue) against ``{column: spark type name}``."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    issues = []
    for c, want in expected.items():
        if c not in actual:
            issues.append((c, "missing"))
        elif actual[c] != want:
            issues.append((c, f"expected {want}, got {actual[c]}"))
    return df.sparkSession.createDataFrame(issues, "column string, issue string")


def validate_dataset(df: DataFrame) -> DataFrame:
    """V05 as a long metric table ``(check, column, metric, value, text)``. Three
    passes: rows, missing values and moments; outliers; duplicates."""
    spark, nums = df.sparkSession, numeric_columns(df)
    first = df.select(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(is_missing(df, c).cast("long")).alias(f"z{i}") for i, c in enumerate(df.columns)],
        *[F.avg(value_or_null(df, c)).cast("double").alias(f"m{i}") for i, c in enumerate(nums)],
        *[F.stddev_samp(value_or_null(df, c)).alias(f"s{i}") for i, c in enumerate(nums)],
    ).first()
    n = first["n"]
    missing = {c: first[f"z{i}"] or 0 for i, c in enumerate(df.columns)}
    far = {}
    for i, c in enumerate(nums):
        m, s = first[f"m{i}"], first[f"s{i}"]
        if s:
            far[c] = F.abs((value_or_null(df, c) - F.lit(m)) / F.lit(s)) > 3.0
    counted = df.select(*[F.count(F.when(cond, 1)).alias(f"o{i}") for i, cond in enumerate(far.values())]).first() if far else ()
    outliers = {c: k for c, k in zip(far, counted) if k}

    rows = [("shape", None, "row_count", float(n), None), ("shape", None, "column_count", float(len(df.columns)), None)]
    rows += [("dtype", f.name, "dtype", None, f.dataType.simpleString()) for f in df.schema.fields]
    rows.append(("missing", None, "total_missing", float(sum(missing.values())), None))
    rows += [("missing", c, "missing_count", float(k), None) for c, k in missing.items() if k]
    for c, k in outliers.items():
        rows += [("outliers", c, "count", float(k), None), ("outliers", c, "percentage", round(k / n * 100, 2), None)]
    known = spark.createDataFrame(rows, "check string, column string, metric string, value double, text string")
    both = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("duplicate_count", "duplicate_percentage")]
    none = F.lit(None).cast("string")
    dups = check_duplicates(df).select(F.explode(F.array(*both)).alias("p")).select(
        F.lit("duplicates").alias("check"), none.alias("column"), "p.metric", "p.value", none.alias("text")
    )
    return known.unionByName(dups)


def detect_anomalies(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, limit: int = 10):
    """Values strictly outside [Q1 - 3 IQR, Q3 + 3 IQR], columns judged
    independently. Returns (summary DF, anomaly rows DF with the first
    ``limit`` order keys per column)."""
    spark = df.sparkSession
    cols = columns or numeric_columns(df)
    qs = column_quantiles(df, cols, [0.25, 0.75]) if cols else {}
    bounds = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        bounds[c] = (q1 - 3 * iqr, q3 + 3 * iqr)
    if not bounds:
        empty = spark.createDataFrame([], "column string, anomaly_count long, lower_bound double, upper_bound double")
        return empty, spark.createDataFrame([], "column string, rank int")
    conds = {c: (value_or_null(df, c) < F.lit(lo)) | (value_or_null(df, c) > F.lit(hi)) for c, (lo, hi) in bounds.items()}
    counted = df.select(*[F.count(F.when(cond, 1)).alias(f"a{i}") for i, cond in enumerate(conds.values())])
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"a{i}").cast("long").alias("anomaly_count"),
            F.lit(lo).alias("lower_bound"),
            F.lit(hi).alias("upper_bound"),
        )
        for i, (c, (lo, hi)) in enumerate(bounds.items())
    ]
    summary = counted.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("anomaly_count") > 0)
    rows = None
    if order_by:
        # one scan: each row emits the columns it is anomalous in, then the
        # first ``limit`` order keys per column (salted top-k, bounded)
        flags = F.filter(F.array(*[F.when(cond, F.lit(c)) for c, cond in conds.items()]), lambda x: x.isNotNull())
        hits = df.select(*[q(o) for o in order_by], F.explode(flags).alias("column"))
        rows = top_k_per_group(hits, ["column"], [F.col(o) for o in order_by], limit, rank_col="__r").select("column", *order_by)
    return summary, rows
