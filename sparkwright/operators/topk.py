"""Top-k rows per group without sorting a whole (possibly hot) group in one task.

Level 1 ranks inside ``(group, salt)`` where the salt is a hash of the order
key, so a group holding a third of the table is spread over ``salts`` tasks.
Level 2 ranks the at most ``salts * k`` survivors of each group. The global
top-k of a group is always among the level-1 survivors, so the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    group_by: list[str],
    order_by: list[Column],
    k: int,
    rank_col: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """Rows with ``row_number() <= k`` per group under ``order_by`` (which must
    be a total order for a deterministic answer), plus ``rank_col``."""
    if salts is None:  # a hot group spreads over as many tasks as a shuffle has
        salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # any deterministic function of the row spreads a hot group: hash all columns
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    salted = df.withColumn("__salt", salt)
    w1 = Window.partitionBy(*group_by, "__salt").orderBy(*order_by)
    level1 = salted.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k).drop("__r1", "__salt")
    w2 = Window.partitionBy(*group_by).orderBy(*order_by)
    return level1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
