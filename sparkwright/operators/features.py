"""Feature engineering (F01-F08). Order-dependent features take ``order_by``
(unique) and optional ``group_by``; all run through :mod:`prefix`, so no
window ever sees more than one range bucket of one group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DATE_TYPES, FLOAT_TYPES, NUMERIC_TYPES, value_or_null
from ..functions.numeric import safe_ratio
from . import prefix
from .cleaning import parse_timestamp, q
from .transform import date_parts


def _groups(group_by) -> list[str]:
    if group_by is None:
        return []
    return [group_by] if isinstance(group_by, str) else list(group_by)


def create_ratios(df: DataFrame, numerator: str, denominator: str, new_name: str | None = None) -> DataFrame:
    """zero / null denominator (or null numerator) -> 0."""
    name = new_name or f"{numerator}_to_{denominator}_ratio"
    return df.withColumn(name, safe_ratio(numerator, denominator))


def create_running_total(df: DataFrame, column: str, order_by, group_by=None, **kw) -> DataFrame:
    """cumulative sum; a null row stays null, the sum continues past it."""
    return prefix.running(df, {f"{column}_running_total": ("sum", column)}, order_by, _groups(group_by), **kw)


def create_lag(df: DataFrame, column: str, periods: int = 1, order_by=None, group_by=None, **kw) -> DataFrame:
    """shift by ``periods`` (negative = lead)."""
    return prefix.lag(df, column, periods, order_by, _groups(group_by), name=f"{column}_lag_{periods}", **kw)


def create_pct_change(df: DataFrame, column: str, periods: int = 1, order_by=None, group_by=None, **kw) -> DataFrame:
    """pandas 2 ``pct_change(periods) * 100``: forward-fill first, then
    ``x / x.shift(periods) - 1``; a zero base gives null (pandas: inf / NaN)."""
    groups = _groups(group_by)
    name = f"{column}_pct_change_{periods}"
    ff = "__ff_" + column
    cut, buckets = prefix._bucketize(df, order_by, group_by=groups, **kw)  # serve both ordered passes
    filled = prefix.running(cut, {ff: ("last", column)}, order_by, groups, cut=buckets)
    shifted = prefix.lag(filled, ff, periods, order_by, groups, name="__prev", cut=buckets)
    pct = (F.try_divide(F.col(ff), F.nullif(F.col("__prev"), F.lit(0.0))) - 1) * 100
    return shifted.withColumn(name, pct).drop(ff, "__prev", prefix.BUCKET)


def create_rolling_avg(df: DataFrame, column: str, window: int = 3, order_by=None, group_by=None, **kw) -> DataFrame:
    """mean of the last ``window`` rows, null unless all are present."""
    return prefix.rolling_mean(df, column, window, order_by, _groups(group_by), **kw)


def create_cumulative_metrics(df: DataFrame, column: str, order_by=None, group_by=None, **kw) -> DataFrame:
    """cumsum, cummax, cummin (null rows stay null)."""
    specs = {
        f"{column}_cumsum": ("sum", column),
        f"{column}_cummax": ("max", column),
        f"{column}_cummin": ("min", column),
    }
    return prefix.running(df, specs, order_by, _groups(group_by), **kw)


def encode_cyclical_features(df: DataFrame, column: str, max_value: float | None = None) -> DataFrame:
    """sin / cos of 2*pi*x/max; max defaults to the column maximum
    (only for int / float columns, otherwise the frame is returned as is)."""
    if max_value is None:
        if not isinstance(df.schema[column].dataType, (T.IntegerType, T.LongType) + FLOAT_TYPES):
            return df
        max_value = df.select(F.max(q(column))).first()[0]
    ang = F.lit(2 * math.pi) * q(column) / F.lit(max_value)
    return df.withColumn(f"{column}_sin", F.sin(ang)).withColumn(f"{column}_cos", F.cos(ang))


def generate_features(
    df: DataFrame,
    numeric_columns: list[str] | None = None,
    date_columns: list[str] | None = None,
    order_by=None,
    **kw,
) -> tuple[DataFrame, list[str]]:
    """cumsum / cummax / cummin / rolling_avg_3 per numeric column and five
    date parts per date column. All running metrics share one bucketed pass."""
    new: list[str] = []
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in (numeric_columns or []) if c in types and isinstance(types[c], NUMERIC_TYPES)]
    if nums:
        if order_by is None:
            raise ValueError("numeric features need order_by")
        df, buckets = prefix._bucketize(df, order_by, **kw)  # serve both ordered passes
        specs = {}
        for c in nums:
            specs[f"{c}_cumsum"] = ("sum", c)
            specs[f"{c}_cummax"] = ("max", c)
            specs[f"{c}_cummin"] = ("min", c)
        df = prefix.running(df, specs, order_by, cut=buckets)

        def build(w):
            fr = w.rowsBetween(-2, 0)
            x = {c: value_or_null(df, c) for c in nums}
            return {f"{c}_rolling_avg_3": F.when(F.count(x[c]).over(fr) >= 3, F.avg(x[c]).over(fr)) for c in nums}

        df = prefix.sliding(df, build, order_by, back=2, cut=buckets).drop(prefix.BUCKET)
        for c in nums:
            new.extend([f"{c}_cumsum", f"{c}_cummax", f"{c}_cummin", f"{c}_rolling_avg_3"])
        order = list(df.columns)
        df = df.select(*[q(c) for c in order])
    for c in date_columns or []:
        if c not in types:
            continue
        col = q(c) if isinstance(types[c], DATE_TYPES) else parse_timestamp(c)
        df = df.withColumn(c, col).select("*", *date_parts(q(c), c, weekday_flag=False))
        new.extend([f"{c}_year", f"{c}_month", f"{c}_day", f"{c}_quarter", f"{c}_dayofweek"])
    return df, new
