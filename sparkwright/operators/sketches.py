"""Mergeable quantile sketches (DDSketch, Masson et al., 2019).

A value falls in the bucket ceil(ln |x| / ln gamma) of its sign, gamma = (1 + a) /
(1 - a); the bucket's middle is within the share a of each of its values. A sketch
is its buckets' counts in long form (group columns, sign, bucket, n), so sketches
of days, shards or files are stored like any table and merged by adding counts.
There are at most some thousand buckets per group, whatever the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
_INFINITE = 2**31 - 1


def _gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy: between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def quantile_sketch(df: DataFrame, group_by: list[str], column: str, accuracy: float = ACCURACY) -> DataFrame:
    """(``group_by``, sign, bucket, n). Nulls and NaN do not count; infinities have
    buckets of their own. One aggregate, combined map-side."""
    x = F.col(f"`{column}`").cast("double")
    size = F.abs(x)
    bucket = F.when(size == float("inf"), _INFINITE).when(x == 0, 0).otherwise(F.ceil(F.ln(size) / math.log(_gamma(accuracy))).cast("int"))
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(
        *[F.col(f"`{g}`") for g in group_by], F.signum(x).cast("int").alias("sign"), bucket.alias("bucket")
    )
    return rows.groupBy(*[F.col(f"`{g}`") for g in group_by], "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, group_by: list[str]) -> DataFrame:
    """Sketches of finer groups as sketches of ``group_by``."""
    return sketches.groupBy(*[F.col(f"`{g}`") for g in group_by], "sign", "bucket").agg(F.sum("n").alias("n"))


def _middle(accuracy: float) -> Column:
    gamma = _gamma(accuracy)
    middle = F.pow(F.lit(gamma), F.col("bucket")) * (2 / (gamma + 1))
    return F.when(F.col("bucket") == _INFINITE, float("inf")).when(F.col("sign") == 0, 0.0).otherwise(middle) * F.col("sign")


def sketch_quantiles(sketch: DataFrame, group_by: list[str], probabilities: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """(``group_by``, p, n, value): for each p, within the share ``accuracy`` of
    the value at rank floor(p (n - 1)) of the sorted rows."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities: between 0 and 1")
    keys = [F.col(f"`{g}`") for g in group_by]
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    counted = sketch.select("*", F.sum("n").over(order).alias("__upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("__all"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    rank = F.floor(F.col("p") * (F.col("__all") - 1))
    hit = counted.select("*", asked).where((F.col("__upto") > rank) & (F.col("__upto") - F.col("n") <= rank))
    return hit.select(*keys, "p", F.col("__all").alias("n"), _middle(accuracy).alias("value"))
