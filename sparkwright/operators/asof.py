"""As-of join: each left row gets the latest right row with the same key and
``right.ts <= left.ts`` (DuckDB ``ASOF LEFT JOIN``). Spark has no keyword, so
both sides are unioned and a forward fill runs per key along time -- through
:mod:`prefix`, so a key holding a third of the rows is still split by time
range instead of landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    right_cols: list[str],
    strict: bool = False,
    **kw,
) -> DataFrame:
    """Left rows with ``right_cols`` of the matched right row (null when none).
    ``strict`` requires ``right.ts < left.ts``. A null key or time matches
    nothing, as in SQL: such left rows go around the fill, such right rows go."""
    lcols = left.columns
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    outside = left.where(~(known & F.col(left_ts).isNotNull()))
    left = left.where(known & F.col(left_ts).isNotNull())
    right = right.where(known & F.col(right_ts).isNotNull())
    side_l = 0 if strict else 1  # at equal time right rows sort first unless strict
    l = left.select(
        *[F.col(k).alias("__k_" + k) for k in on],
        F.col(left_ts).alias("__t"),
        F.lit(side_l).alias("__side"),
        F.struct(*[F.col(c) for c in lcols]).alias("__l"),
        F.lit(None).cast(right.select(F.struct(*right_cols)).schema[0].dataType).alias("__r"),
    )
    r = right.select(
        *[F.col(k).alias("__k_" + k) for k in on],
        F.col(right_ts).alias("__t"),
        F.lit(1 - side_l).alias("__side"),
        F.lit(None).cast(l.schema["__l"].dataType).alias("__l"),
        F.struct(*[F.col(c) for c in right_cols]).alias("__r"),
    )
    both = l.unionByName(r)
    filled = prefix.running(both, {"__m": ("last", "__r")}, ["__t", "__side"], ["__k_" + k for k in on], **kw)
    out = filled.where(F.col("__l").isNotNull())
    matched = out.select(*[F.col("__l").getField(c).alias(c) for c in lcols], *[F.col("__m").getField(c).alias(c) for c in right_cols])
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right_cols]
    return matched.union(outside.select(*lcols, *nothing))
