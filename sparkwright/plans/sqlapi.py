"""Q01: read-only SQL entry point over Spark SQL (Catalyst plans, optimises, runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Base classes of every plan that changes or defines something.
_WRITING = (
    "org.apache.spark.sql.catalyst.plans.logical.Command",
    "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement",
)


def run_select(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Run a single query (``SELECT``, ``WITH ... SELECT``); anything else raises
    ``ValueError``. The text is parsed first and its plan inspected, so a
    command, insert, merge or the like -- also behind ``WITH`` -- never runs.
    Spark's parser takes one statement only."""
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # a Py4J or a converted parse error: not a query
        raise ValueError(f"Only SELECT queries are allowed: {str(e).splitlines()[0]}") from e
    if _writes(spark, plan):
        raise ValueError("Only SELECT queries are allowed")
    return spark.sql(text, args or None)


def _writes(spark: SparkSession, plan) -> bool:
    """True if the parsed plan, or any plan below it, is a command."""
    kinds = [spark._jvm.java.lang.Class.forName(k) for k in _WRITING]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return True
        for below in (node.children(), node.innerChildren()):
            todo += [x for x in (below.apply(i) for i in range(below.size())) if hasattr(x, "children")]
    return False
