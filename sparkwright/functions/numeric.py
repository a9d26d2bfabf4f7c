"""Row-level numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_or_null(c: str | Column) -> Column:
    """NaN and +-Infinity become null (JSON-safe values)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def _sanitize(expr: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return finite_or_null(expr)
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.DoubleType, T.ArrayType, T.StructType)):
        return F.transform(expr, lambda x: _sanitize(x, dt.elementType))
    if isinstance(dt, T.StructType) and any(
        isinstance(f.dataType, (T.FloatType, T.DoubleType, T.ArrayType, T.StructType)) for f in dt.fields
    ):
        return F.when(
            expr.isNotNull(),
            F.struct(*[_sanitize(expr.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]),
        )
    if isinstance(dt, T.MapType) and isinstance(dt.valueType, (T.FloatType, T.DoubleType)):
        return F.transform_values(expr, lambda k, v: finite_or_null(v))
    return expr


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN / Inf -> null in every float column, recursing into arrays, structs, maps."""
    return df.select(*[_sanitize(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den with a zero or null denominator (or null numerator) giving 0."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def number_like(s: Column) -> Column:
    """Cheap necessary condition for a (stripped) text to cast to a number: it
    has a digit or is a nan / inf / infinity literal. Skipping the cast for the
    rest avoids costly failing parses and changes no result."""
    return s.rlike("[0-9]") | s.rlike("(?i)^[+-]?(nan|inf|infinity)$")
