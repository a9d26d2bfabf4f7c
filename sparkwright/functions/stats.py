"""Aggregate expressions with pandas' (sample-corrected) definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1 (pandas ``skew``); null below 3 values."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``); null below 4 values."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def null_count(c: str) -> Column:
    return F.sum(F.col(c).isNull().cast("long"))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded like the reference; 0 when the whole is 0."""
    return F.when(whole > 0, F.round(part.cast("double") / whole * 100, digits)).otherwise(F.lit(0.0))
