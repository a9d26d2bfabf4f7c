"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. Per language and source a
minimum-covariance-determinant estimate (the mean and covariance of the
``SHARE`` of rows that are closest to it) says what is usual there; rows whose
squared Mahalanobis distance exceeds ``CUTOFF`` are rejected.

All of it is DataFrame work: an estimate is a table with one row per group;
a concentration step joins it to the rows, bins the distances, sums counts,
vectors and products per (group, bin), and adds up the bins of the closest
rows. A group of any size is combined map-side to at most a few hundred bins.
The vectors are integers (1/1024 units), so all sums are exact and no result
depends on the order of rows or on retried tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import native_text as nt
from .common import cut

UNIT = 1024
SYMBOLS = "#*$%&|<>"
#: Share of a group's rows that the estimate rests on.
SHARE = 0.5
STEPS = 5
#: Squared distance beyond which a row is rejected: about the 0.99999 quantile
#: of chi-square with five degrees of freedom.
CUTOFF = 31.0
#: Least standard deviation per statistic, in its own (logarithmic) unit: what
#: is usual in any corpus is no outlier in a group without any spread.
FLOORS = {"len": 0.15, "sym": 0.35, "dup": 1.0, "rep": 1.0, "size": 1.5}
_NAMES = list(FLOORS)
_P = len(_NAMES)


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution function by its power series."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the closest ``share`` of a normal
    sample estimate the whole one's."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, _P) < share else (low, mid)
    return share / _chi2_cdf(low, _P + 2)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple = ("lang", "source")) -> DataFrame:
    """Counts of every whole text, base_failed, and the vector (x_*)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(by)], text.alias("text"))
    count = nt.let(nt.words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), nt.repeated_words(w).alias("n_repeat_words")))
    rows = rows.select(
        "id", *[f"by{k}" for k in range(len(by))], count.alias("words"),
        nt.word_chars(F.col("text")).alias("word_chars"),
        nt.count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        nt.duplicate_lines(F.col("text")).alias("n_dup_lines"),
    ).select("*", "words.*").drop("words")
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    chars = F.greatest("word_chars", F.lit(1))
    some = F.greatest(n, F.lit(1))
    vector = {
        "len": F.log(chars / some),
        "sym": F.log1p(100 * F.col("n_symbols") / chars),
        "dup": F.log1p(F.col("n_dup_lines")),
        "rep": F.log1p(100 * rep / some),
        "size": F.log(some),
    }
    return rows.withColumn("base_failed", (n < 10) | (100 * rep > 20 * n)).withColumns(
        {f"x_{k}": F.round(v * UNIT).cast("long") for k, v in vector.items()}
    )


def _weights(cov: dict[tuple[int, int], str], table: DataFrame) -> DataFrame:
    """Adds w_ij, the inverse of the Cholesky factor of the covariance columns."""
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(cov[i, j])
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            table = table.withColumn(f"l_{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}{j}"))
    for j in range(_P):
        table = table.withColumn(f"w_{j}{j}", 1 / F.col(f"l_{j}{j}"))
        for i in range(j + 1, _P):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total - F.col(f"l_{i}{k}") * F.col(f"w_{k}{j}")
            table = table.withColumn(f"w_{i}{j}", total / F.col(f"l_{i}{i}"))
    return table


def _distance() -> Column:
    """Squared Mahalanobis distance of x_* from m_* under w_*."""
    total = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}{j}") * (F.col(f"x_{_NAMES[j]}") - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _with_estimate(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the estimate of their group; null names are a group too."""
    same = None
    for k in keys:
        eq = rows[k].eqNullSafe(estimate[f"e_{k}"])
        same = eq if same is None else same & eq
    return rows.join(estimate, same, "left")


def _estimate_columns(keys: list[str]) -> list[str]:
    return [f"e_{k}" for k in keys] + [f"m_{i}" for i in range(_P)] + [f"w_{i}{j}" for i in range(_P) for j in range(i + 1)]


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians with the floors as scales: the start of the concentration."""
    table = rows.groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(
        *[F.median(f"x_{n}").alias(f"m_{i}") for i, n in enumerate(_NAMES)]
    )
    for i, n in enumerate(_NAMES):
        for j in range(i + 1):
            table = table.withColumn(f"w_{i}{j}", F.lit(1 / (FLOORS[n] * UNIT) if i == j else 0.0))
    return table.select(*_estimate_columns(keys))


def _concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """The estimate from the ``SHARE`` of each group that is closest now."""
    x = [F.col(f"x_{n}") for n in _NAMES]
    sums = [F.sum(x[i]).alias(f"s_{i}") for i in range(_P)]
    sums += [F.sum(x[i] * x[j]).alias(f"q_{i}{j}") for i in range(_P) for j in range(i + 1)]
    bins = (
        _with_estimate(rows, estimate, keys)
        .withColumn("bin", F.floor(16 * F.log2(1 + _distance())))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
    )
    whole = Window.partitionBy(*keys)
    before = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    closest = bins.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(whole)).where(
        F.col("before") < F.ceil(F.lit(SHARE) * F.col("all"))
    )
    names = ["n", *[f"s_{i}" for i in range(_P)], *[f"q_{i}{j}" for i in range(_P) for j in range(i + 1)]]
    table = closest.groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(*[F.sum(c).alias(c) for c in names])
    cov = {}
    for i, name in enumerate(_NAMES):
        table = table.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
        for j in range(i + 1):
            cov[i, j] = f"c_{i}{j}"
            part = F.col(f"q_{i}{j}") / F.col("n") - (F.col(f"s_{i}") / F.col("n")) * (F.col(f"s_{j}") / F.col("n"))
            floor = (FLOORS[name] * UNIT) ** 2 if i == j else 0.0
            table = table.withColumn(f"c_{i}{j}", factor * part + floor)
    return _weights(cov, table).select(*_estimate_columns(keys))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple = ("lang", "source")) -> DataFrame:
    """(``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept), one row per input row.

    Rows that fail the base rules are no part of the estimates and are not
    kept (distance null). Null texts have no words and fail. A null language
    or source is a group of its own. A group of one row, or of equal rows,
    has the floors as its spread and keeps them. Ties at the edge of the
    closest share are all taken in. Repeated ids and rows count each. Columns
    not named here are ignored, whatever their names. Empty: empty."""
    keys = [f"by{k}" for k in range(len(by))]
    rows = cut(statistics(docs, id_col, text_col, by))
    fit = rows.where("not base_failed")
    estimate = cut(_start(fit, keys))
    factor = _consistency(SHARE)
    for _ in range(STEPS):
        estimate = cut(_concentrate(fit, estimate, keys, factor))
    far = F.when(~F.col("base_failed"), _distance())
    judged = _with_estimate(rows, estimate, keys).withColumn("distance", far)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "distance", F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)).alias("kept"),
    )
