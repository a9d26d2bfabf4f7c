"""Column classes chosen from the schema only (no Spark job).

The reference selects columns by pandas dtype class; these predicates map
those classes onto Spark types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATE_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _fields(df: DataFrame):
    return df.schema.fields


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Numeric columns (pandas ``select_dtypes(np.number)``: bool excluded unless asked)."""
    out = []
    for f in _fields(df):
        if isinstance(f.dataType, NUMERIC_TYPES) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if isinstance(f.dataType, DATE_TYPES)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if isinstance(f.dataType, FLOAT_TYPES)]


def is_numeric(df: DataFrame, name: str, include_bool: bool = False) -> bool:
    return name in numeric_columns(df, include_bool)


def dtype_name(df: DataFrame, name: str) -> str:
    """Spark SQL type name of a column (``bigint``, ``double``, ``string`` ...)."""
    return df.schema[name].dataType.simpleString()


def is_missing(df: DataFrame, name: str) -> Column:
    """pandas ``isnull``: null, and NaN in float columns."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def value_or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing (null)."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return F.when(~F.isnan(c), c)
    return c
