"""Recursion, quantile sketches, violin density, keyed store, full text, strips."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.functions.text import UNICODE_SPACE, strip_unicode
from sparkwright.operators import intervaljoin, recursion
from sparkwright.operators.sketches import merge_sketches, quantile_sketch, sketch_quantiles
from sparkwright.plans import chartdata as K
from sparkwright.plans import docs as D
from sparkwright.plans.sqlapi import run_select
from sparkwright.sources.keyedstore import KeyedStore, StaleWriter


# ------------------------------------------------------------------ recursion
@pytest.mark.parametrize("compact", [2, 8])
def test_reachability_ends_on_cycles(spark, monkeypatch, compact):
    monkeypatch.setattr(recursion, "COMPACT", compact)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 112)] + [(112, 100), (None, 5), (5, None)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = recursion.reachable(df, spark.createDataFrame([(i,) for i in (0, 1, 100, 500, None)], "s int"), "a", "b", "s")
    want = set()
    for s in (0, 1, 100, 500):
        todo = [s]
        while todo:
            n = todo.pop()
            if (s, n) not in want:
                want.add((s, n))
                todo += [b for a, b in edges if a == n and b is not None]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_fixpoint_depth_and_nulls(spark):
    seed = spark.createDataFrame([(0, None), (0, None)], "n int, x string")
    step = lambda new: new.select((F.col("n") + 1).alias("n"), "x")
    assert sorted(r.n for r in recursion.fixpoint(seed, step, max_rounds=3).collect()) == [0, 1, 2, 3]
    assert recursion.fixpoint(seed.limit(0), step).collect() == []


def test_recursive_cte_passes_the_guard(spark):
    got = run_select(spark, "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT sum(n) AS s FROM t")
    assert got.first().s == 15


# ------------------------------------------------------------------- sketches
def test_merged_sketches_equal_one_and_keep_the_error(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 3) * rng.choice([1, 1, -1]) for _ in range(3000)] + [0.0, -0.0, float("inf"), float("-inf")]
    rows = [(rng.choice(["a", "b", None]), i % 6, v) for i, v in enumerate(values)] + [("a", 1, None), ("b", 2, float("nan"))]
    df = spark.createDataFrame(rows, "g string, day int, x double")
    days = quantile_sketch(df, ["g", "day"], "x", 0.02)
    merged, one = merge_sketches(days, ["g"]), quantile_sketch(df, ["g"], "x", 0.02)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, one.collect()))
    asked = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): (r.n, r.value) for r in sketch_quantiles(merged, ["g"], asked, 0.02).collect()}
    assert len(got) == 15
    for g in ("a", "b", None):
        own = sorted(v for k, _, v in rows if k == g and v is not None and not math.isnan(v))
        for p in asked:
            n, value = got[g, p]
            exact = own[math.floor(p * (len(own) - 1))]
            assert n == len(own) and (value == exact or abs(value - exact) <= 0.02 * abs(exact) * (1 + 1e-9))
    with pytest.raises(ValueError):
        sketch_quantiles(one, ["g"], [1.5])


# ------------------------------------------------------------- violin density
def test_density_is_near_the_exact_kernel_and_sums_to_one(spark):
    rng = np.random.default_rng(5)
    data = [("n", float(x)) for x in rng.normal(10, 3, 800)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), ("n", float("inf"))]
    got = K.violin_density(spark.createDataFrame(data, "g string, x double"), "x", "g").toPandas().sort_values("point")
    assert set(got["g"]) == {"n", "one", "same"} and all(got.groupby("g").size() == 101)
    for _, own in got.groupby("g"):
        assert np.trapezoid(own["density"], own["x"]) == pytest.approx(1, abs=0.01)
    x = np.array([v for g, v in data if g == "n" and math.isfinite(v)])
    h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    own = got[got["g"] == "n"]
    exact = np.exp(-0.5 * ((own["x"].to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.abs(own["density"] - exact).max() < 0.01 * exact.max()


# ----------------------------------------------------------------- keyed store
def test_saves_persist_and_a_stale_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "name string, payload string")
    a = KeyedStore(spark, path, "payload string")
    assert a.read().collect() == [] and a.list_all().collect() == []
    assert a.save(rows(("x", "1"), ("y", "2")), now=dt.datetime(2024, 1, 1)) == 1
    b = KeyedStore(spark, path, "payload string")
    assert b.version == 1
    assert a.save(rows(("x", "3"), ("z", "4")), now=dt.datetime(2024, 1, 2)) == 2
    with pytest.raises(StaleWriter):
        b.save(rows(("y", "lost?")))
    assert sorted((r.id, r.name, r.payload) for r in b.read().collect()) == [(1, "x", "1"), (2, "y", "2")]
    assert b.refresh() == 2 and b.save(rows(("y", "5")), now=dt.datetime(2024, 1, 3)) == 3
    assert [(r.id, r.name, r.payload) for r in b.list_all().collect()] == [(2, "y", "5"), (3, "z", "4"), (1, "x", "3")]
    assert b.get("x", "name").first().created_at == dt.datetime(2024, 1, 1) and b.get(3).first().name == "z"
    assert b.delete(spark.createDataFrame([(1,)], "id long")) == 4
    last = KeyedStore(spark, path, "payload string")
    assert last.version == 4 and sorted(r.name for r in last.read().collect()) == ["y", "z"]
    assert sorted(r.name for r in last.read(1).collect()) == ["x", "y"]
    last.clean()
    assert last.versions() == [1, 2, 3, 4] and sorted(r.name for r in last.read().collect()) == ["y", "z"]


# ------------------------------------------------------------------- full text
@pytest.mark.parametrize("chunk,kw", [(7, {}), (1000, {}), (7, {"rows_per_bucket": 5})])
def test_chunks_concatenate_to_the_full_text(spark, chunk, kw):
    rng = random.Random(6)
    pages = [(d, p, rng.choice([None, "", "é한x", "word " * rng.randrange(9), "\n", "abcdefg"])) for d in ("a", "b") for p in range(25)]
    pages += [("empty", 1, None), ("one", 3, "x" * 40), ("exact", 1, "1234567")]
    got = D.full_text(spark.createDataFrame(pages, "document string, page int, text string").repartition(4), chunk, **kw).collect()
    for d in {p[0] for p in pages}:
        whole = "\n\n".join(t or "" for k, _, t in sorted(pages, key=lambda p: p[:2]) if k == d)
        own = sorted((r for r in got if r.document == d), key=lambda r: r.chunk)
        assert "".join(r.text for r in own) == whole
        assert [r.start for r in own] == [i * chunk for i in range(len(own))] and all(len(r.text) == chunk for r in own[:-1])
        assert len(own) == max(1, -(-len(whole) // chunk))


def test_sections_follow_headings(spark):
    text = "  lead \n\n1. First　\n body a\nbody b \n2. Empty\nChapter 3\nlast"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, ""), ("d", 3, "1. only heading"), ("d", 4, "no heading")], "document string, page int, text string")
    got = sorted((r.page, r.section_no, r.heading, r.text) for r in D.sections(pages).collect())
    assert got == [(1, 0, "", "lead"), (1, 1, "1. First", "body a\nbody b"), (1, 3, "Chapter 3", "last"), (4, 0, "", "no heading")]


# ----------------------------------------------------------------------- strip
def test_strip_is_python_strip_and_linear(spark):
    texts = [c + "a" + c + "b" + c for c in UNICODE_SPACE] + ["", UNICODE_SPACE, "​ x ​", " é ", "x"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_unicode("t")).collect()]
    assert all(s == t.strip() for t, s in got)
    long = spark.createDataFrame([("a" + " " * 400_000 + "b ",)], "t string").select(F.length(strip_unicode("t")).alias("n"))
    t0 = time.time()
    assert long.first().n == 400_002 and time.time() - t0 < 10


def test_reachable_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(i):
        made.add(1)
        return i

    df = spark.range(12).select(F.udf(seen, "long")("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = recursion.reachable(df, spark.createDataFrame([(0,)], "s long"), "a", "b", "s")
    assert got.count() == 13 and made.value <= 3 * 12  # 12 rounds


def closure(edges, starts):
    want = set()
    for s in starts:
        todo = [s]
        while todo:
            n = todo.pop()
            if n is not None and (s, n) not in want:
                want.add((s, n))
                todo += [b for a, b in edges if a == n]
    return want


@pytest.mark.parametrize("per_task", [3, 10**6])
def test_reachable_with_many_components(spark, monkeypatch, per_task):
    """Cycles in a row, in each other and apart, chains between them, links of one node to itself."""
    monkeypatch.setattr(intervaljoin, "PAIRS_PER_TASK", per_task)
    monkeypatch.setattr(intervaljoin, "MAX_TASKS", 8)
    rng = random.Random(per_task)
    edges = [(i, i + 1) for i in range(0, 9)] + [(4, 2), (9, 8), (3, 3), (20, 21), (21, 20), (21, 5), (30, 31), (31, 32), (32, 30), (32, 33)]
    edges += [(rng.randrange(40, 70), rng.randrange(40, 70)) for _ in range(36)] + [(None, 1), (2, None)]
    starts = [*range(0, 75, 2), 1, 1, None]
    df = spark.createDataFrame([(f"{a}" if a is not None else None, f"{b}" if b is not None else None) for a, b in edges + edges[:5]], "a string, b string")
    got = recursion.reachable(df, spark.createDataFrame([(f"{s}" if s is not None else None,) for s in starts], "s string"), "a", "b", "s")
    rows = [(int(r.start), int(r.node)) for r in got.collect()]
    assert set(rows) == closure(edges, starts) and len(rows) == len(set(rows))


def test_reachable_lists_a_large_component_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervaljoin, "PAIRS_PER_TASK", 500)
    df = spark.range(100).selectExpr("id AS a", "(id + 1) % 100 AS b").unionAll(spark.range(100).selectExpr("id", "(id * 7 + 3) % 100"))
    got = recursion.reachable(df, spark.range(100).toDF("s"), "a", "b", "s")
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 100 * 100 and max(parts) <= 5000


def test_recursive_query_follows_all_lines_from_all_parts(spark, tmpdir_path):
    """Also lines of small quantity and parts of any number."""
    from __spark_entry__ import queries

    lines = [(1, 1, 41, 1.0), (1, 2, 42, 2.0), (1, 3, 43, 50.0), (2, 1, 43, 3.0), (2, 2, 41, None), (3, 1, 40, 49.0), (3, 2, 7, 48.0), (3, 4, 9, 50.0), (3, 2, 8, 1.0)]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    parts = [7, 9, 40, 41, 42, 43, 43, 80, None]
    spark.createDataFrame([(p,) for p in parts], "p_partkey bigint").write.parquet(f"{tmpdir_path}/part.parquet")
    rows = [tuple(r) for r in queries()["sql_recursive_reachable"](spark, tmpdir_path).collect()]
    want = closure([(a[2], b[2]) for a in lines for b in lines if a[0] == b[0] and b[1] == a[1] + 1], parts)
    assert set(rows) == want and len(rows) == len(want) and (42, 41) in want and (40, 8) in want
