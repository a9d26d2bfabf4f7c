"""Property checks and hot-key behaviour."""

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import cleaning as C
from sparkwright.operators import transform as X
from sparkwright.operators.topk import top_k_per_group
from sparkwright.plans import chartdata as K

from .conftest import SF001


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF001}/lineitem.parquet")


def test_dedup_idempotent(spark, lineitem):
    once = C.remove_duplicates(lineitem.unionByName(lineitem.limit(500)))
    twice = C.remove_duplicates(once)
    assert once.count() == twice.count() == lineitem.dropDuplicates().count()
    sub = C.remove_duplicates(lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    assert C.remove_duplicates(sub, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).count() == sub.count()


def test_histogram_counts_cover_non_null_rows(lineitem):
    d = lineitem.withColumn("x", F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice")))
    h = K.histogram(d, "x", bins=13)
    assert h.agg(F.sum("count")).first()[0] == d.where(F.col("x").isNotNull()).count()
    assert h.count() <= 13


def test_unpivot_of_pivot_keeps_cells(spark, lineitem):
    p = X.pivot(lineitem, "l_returnflag", "l_linestatus", "l_quantity", "sum")
    cells = X.melt(p, ["l_returnflag"]).where(F.col("value").isNotNull()).count()
    assert cells == lineitem.select("l_returnflag", "l_linestatus").distinct().count()


def test_hot_key_dedup_is_an_aggregate(spark, lineitem):
    """A key holding a third of the rows: first-row-per-key runs as a partial
    (map-side) aggregate, never as a window that sorts the whole key in one task."""
    hot = lineitem.withColumn("k", F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    out = C.remove_duplicates(hot, ["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
    first = out.where(F.col("k") == -1).first()
    assert first.l_orderkey == hot.where(F.col("k") == -1).agg(F.min("l_orderkey")).first()[0]


def test_top_k_hot_group(spark, lineitem):
    hot = lineitem.withColumn("g", F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot")).otherwise(F.col("l_returnflag")))
    got = top_k_per_group(hot, ["g"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 4)
    top = got.where(F.col("g") == "hot").orderBy("rank").select("l_extendedprice").collect()
    want = hot.where(F.col("g") == "hot").orderBy(F.col("l_extendedprice").desc()).limit(4).select("l_extendedprice").collect()
    assert top == want


def test_report_index_with_missing_columns(spark):
    from sparkwright.plans.dashboards import report_chart_index

    df = spark.createDataFrame(
        [("a", 1.0, None), ("b", None, 3), ("a", 2.0, 4), (None, 5.0, 5)], "cat string, x double, y int"
    )
    rows = {r.chart: r.rows for r in report_chart_index(df).collect()}
    assert rows["missing_values_bar"] == 3 and rows["missing_values_hbar"] == 3
    assert rows["bar_cat"] == 2 and rows["hist_x"] == 3 and rows["hist_y"] == 3


def test_one_pass_dashboard_handles_null_keys(spark):
    import datetime as dt

    from sparkwright.plans.dashboards import comprehensive_dashboard

    d1, d2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [("a", "x", 1.0, d1), ("a", None, 2.0, d1), (None, "x", 4.0, d2), ("b", "y", 8.0, None), (None, None, 16.0, d2)]
    df = spark.createDataFrame(rows, "c0 string, c1 string, v double, d timestamp_ntz")
    out = comprehensive_dashboard(df, ["v"], ["c0", "c1"], ["d"])
    got = {(r.chart, r.series, r.x): r.y for r in out.collect()}
    # value counts and sums drop null keys; pairs need both keys
    assert got[("bar_c0", "count", "a")] == 2 and ("bar_c0", "count", None) not in got
    assert got[("sum_v_by_c0", "v", "a")] == 3.0 and got[("sum_v_by_c0", "v", "b")] == 8.0
    assert got[("grouped_bar", "x", "a")] == 1.0 and len([k for k in got if k[0] == "grouped_bar"]) == 2
    # date line drops the null date; KPI uses every row
    assert got[("line_v", "v", "2024-01-01 00:00:00")] == 3.0 and got[("line_v", "v", "2024-01-02 00:00:00")] == 20.0
    assert len([k for k in got if k[0] == "line_v"]) == 2
    assert got[("kpi", "sum", "v")] == 31.0 and got[("kpi", "max", "v")] == 16.0
    assert sum(v for k, v in got.items() if k[0] == "hist_v") == 5
