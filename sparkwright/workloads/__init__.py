"""Registered workloads: each ``(spark, sf_dir) -> DataFrame`` query on the
driver tables, with the equivalent DuckDB SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def register(key: str, oracle: str | None = None):
    """Decorator: add a query (and its DuckDB SQL, if any) under ``key``."""

    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate workload {key}")
        REGISTRY[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named driver tables as temp views (resolved when a query is built)."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def load_all() -> None:
    """Import every workload module so its ``@register`` calls run."""
    from . import (  # noqa: F401
        w_chart,
        w_clean,
        w_edge,
        w_feat,
        w_pipe,
        w_profile,
        w_quality,
        w_xform,
        w_sources,
        w_sql,
        w_text,
    )
