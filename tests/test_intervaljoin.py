"""Interval join against all pairs."""

import random

import pytest

from sparkwright.operators import intervaljoin as J
from sparkwright.operators.intervaljoin import interval_join


def pairs(df):
    return sorted((r["i"], r["j"]) for r in df.collect())


def brute(left, right, closed, keyed):
    out = []
    for i, k, a, b in left:
        for j, m, c, d in right:
            if None in (a, b, c, d) or (keyed and (k is None or k != m)):
                continue
            if (a <= b and c <= d and a <= d and c <= b) if closed else (a < b and c < d and a < d and c < b):
                out.append((i, j))
    return sorted(out)


def rows(rng, n, wide):
    out = []
    for i in range(n):
        a = rng.choice([rng.randrange(200), rng.randrange(20), 77])
        size = rng.choice([0, 1, 3, rng.randrange(12), rng.randrange(200) if rng.random() < wide else 2, -1])
        out.append((i, rng.choice([0, 1, None]), None if rng.random() < 0.03 else a, None if rng.random() < 0.03 else a + size))
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("per_bin", [5, 40, 10**6])
def test_equals_all_pairs(spark, closed, per_bin):
    rng = random.Random(per_bin)
    left, right = rows(rng, 300, 0.3), rows(rng, 250, 0.1)
    a = spark.createDataFrame(left, "i int, k int, a int, b int").repartition(3)
    b = spark.createDataFrame(right, "j int, m int, c int, d int")
    for on in ([], [("k", "m")]):
        got = interval_join(a, b, ("a", "b"), ("c", "d"), on, closed, per_bin)
        assert got.columns == ["i", "k", "a", "b", "j", "m", "c", "d"]
        assert pairs(got) == brute(left, right, closed, bool(on))


def test_every_bin_is_covered_by_one_node(spark):
    bins, levels = 16, 5
    cases = [(a, b) for a in range(bins) for b in range(a, bins)]
    df = spark.createDataFrame(cases, "a int, b int").withColumn("n", J._nodes(J.F.col("a"), J.F.col("b"), levels))
    for a, b, nodes in df.collect():
        held = sorted(x for n in nodes for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert held == list(range(a, b + 1)) and len(nodes) <= 2 * levels


def test_bins_by_halving(spark):
    for bounds in ([], [1.0], [1.0, 2.0, float("inf")], [float(x) for x in range(0, 14, 2)]):
        values = [(x / 2,) for x in range(-3, 40)]
        got = spark.createDataFrame(values, "x double").select("x", J._bin(J.F.col("x"), bounds).alias("b")).collect()
        assert all(r.b == sum(c < r.x for c in bounds) for r in got)


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(10,2)", "double", "timestamp_ntz"])
def test_types(spark, kind):
    rng = random.Random(3)
    left, right = rows(rng, 80, 0.3), rows(rng, 60, 0.3)
    day = lambda x: f"timestamp_ntz'2024-01-01' + make_dt_interval({x})"
    cast = lambda x: f"cast({x} AS {kind})" if kind in ("decimal(10,2)", "double") else f"cast({day(x)} AS {kind})"
    a = spark.createDataFrame(left, "i int, k int, a int, b int").selectExpr("i", f"{cast('a')} AS a", f"{cast('b')} AS b")
    b = spark.createDataFrame(right, "j int, m int, c int, d int").selectExpr("j", f"{cast('c')} AS c", f"{cast('d')} AS d")
    assert pairs(interval_join(a, b, ("a", "b"), ("c", "d"), rows_per_bin=7)) == brute(left, right, True, False)


def test_no_nested_loop_and_few_rows_per_wide_interval(spark):
    left = spark.range(4000).selectExpr("id AS i", "id AS a", "id + 3 AS b")
    wide = spark.range(50).selectExpr("id AS j", "id AS c", "id + 3000 AS d")
    bounds = J._bounds([(left, "a"), (wide, "c")], 20)
    assert len(bounds) > 100
    first, last = (J._bin(J._number(wide, c), bounds) for c in "cd")
    sizes = [r.n for r in wide.select(J.F.size(J._nodes(first, last, (len(bounds) + 1).bit_length())).alias("n")).collect()]
    assert max(sizes) <= 16
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = interval_join(left, wide, ("a", "b"), ("c", "d"), rows_per_bin=20)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" in plan


def test_empty_sides_and_errors(spark):
    a = spark.createDataFrame([(1, 2, 3)], "i int, a int, b int")
    b = spark.createDataFrame([(1, 2, 3)], "j int, c int, d int")
    assert pairs(interval_join(a, b, ("a", "b"), ("c", "d"))) == [(1, 1)]
    assert pairs(interval_join(a.limit(0), b, ("a", "b"), ("c", "d"))) == []
    assert pairs(interval_join(a, b.limit(0), ("a", "b"), ("c", "d"), rows_per_bin=1)) == []
    with pytest.raises(ValueError):
        interval_join(a, a, ("a", "b"), ("a", "b"))
    text = spark.createDataFrame([(1, "x", "y")], "j int, c string, d string")
    with pytest.raises(TypeError):
        interval_join(a, text, ("a", "b"), ("c", "d"))


def test_hot_node_is_spread_by_its_pairs(spark, monkeypatch):
    """A few rows in one node hold all pairs: no task lists more than its share."""
    monkeypatch.setattr(J, "PAIRS_PER_TASK", 2000, raising=False)
    left = spark.range(300).coalesce(1).selectExpr("id AS i", "id AS a", "id + 1 AS b")
    wide = spark.range(200).coalesce(1).selectExpr("id AS j", "-id AS c", "id + 1000 AS d")
    got = interval_join(left, wide, ("a", "b"), ("c", "d"))
    parts = [r["count"] for r in got.groupBy(J.F.spark_partition_id()).count().collect()]
    assert sum(parts) == 300 * 200 and max(parts) <= 20_000
    assert pairs(got) == [(i, j) for i in range(300) for j in range(200)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("pairs_per_task", [1, 300])
def test_grid_equals_all_pairs(spark, monkeypatch, closed, pairs_per_task):
    monkeypatch.setattr(J, "PAIRS_PER_TASK", pairs_per_task, raising=False)
    monkeypatch.setattr(J, "MAX_TASKS", 8, raising=False)
    rng = random.Random(pairs_per_task)
    left, right = rows(rng, 120, 0.3), rows(rng, 90, 0.4)
    left, right = left + left[:20], right + right[:20]  # repeated rows each match
    a = spark.createDataFrame(left, "i int, k int, a int, b int").repartition(3)
    b = spark.createDataFrame(right, "j int, m int, c int, d int")
    for on in ([], [("k", "m")]):
        got = interval_join(a, b, ("a", "b"), ("c", "d"), on, closed, 20)
        assert got.columns == ["i", "k", "a", "b", "j", "m", "c", "d"]
        assert pairs(got) == brute(left, right, closed, bool(on))


def test_grid_with_keys_of_two_types(spark, monkeypatch):
    """'1' and '01' both equal 1: a split node repeats no pair."""
    monkeypatch.setattr(J, "PAIRS_PER_TASK", 20, raising=False)
    monkeypatch.setattr(J, "MAX_TASKS", 4, raising=False)
    a = spark.range(12).selectExpr("id AS i", "id % 2 AS k", "id AS a", "id + 2 AS b")
    b = spark.range(20).selectExpr("id AS j", "elt(1 + id % 4, '1', '01', '0', NULL) AS m", "-id AS c", "id + 20 AS d")
    want = [(i, j) for i in range(12) for j in range(20) if {0: 1, 1: 1, 2: 0}.get(j % 4) == i % 2]
    assert pairs(interval_join(a, b, ("a", "b"), ("c", "d"), [("k", "m")])) == want


def test_bins_of_many_bounds(spark):
    """Looked up in two steps, at, between and past the bounds, empty bins at the end included."""
    for n, size in ((127, 128), (128, 256), (300, 512), (1023, 1024)):
        bounds = [float(x) for x in range(0, 2 * n, 2)] + [float("inf")] * (size - 1 - n)
        df = spark.range(-3, 2 * n + 5).selectExpr("id / 2 * 2 AS x", "id AS other")
        got = J._binned(df, "x", bounds, "b")
        assert got.columns == ["x", "other", "b"] and got.schema["b"].dataType.simpleString() == "int"
        assert all(r.b == sum(c < r.x for c in bounds) for r in got.collect())


@pytest.mark.parametrize("closed", [True, False])
def test_many_bounds_equal_all_pairs(spark, monkeypatch, closed):
    monkeypatch.setattr(J, "CELL", 4)
    rng = random.Random(11)
    left, right = rows(rng, 200, 0.3), rows(rng, 150, 0.2)
    a = spark.createDataFrame(left + left[:20], "i int, k int, a int, b int").repartition(3)
    b = spark.createDataFrame(right + right[:20], "j int, m int, c int, d int")
    for on in ([], [("k", "m")]):
        got = interval_join(a, b, ("a", "b"), ("c", "d"), on, closed, 5)
        assert pairs(got) == brute(left + left[:20], right + right[:20], closed, bool(on))


def test_plan_text_does_not_hold_the_bounds(spark):
    """The driver keeps the texts of all plans; thousands of bounds may not stand in them."""
    left = spark.range(12_000).selectExpr("id AS i", "id * 3 AS a", "id * 3 + 1 AS b")
    right = spark.range(8_000).selectExpr("id AS j", "id * 3 + 1 AS c", "id * 3 + 2 AS d")
    got = interval_join(left, right, ("a", "b"), ("c", "d"), rows_per_bin=1)
    assert got.where("i = j").count() == got.count() == 8_000
    assert len(got._jdf.queryExecution().toString()) < 1_000_000
