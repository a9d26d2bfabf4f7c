"""Two-phase ordered windows and exact quantiles against plain Spark windows /
numpy, with tiny buckets so every bucket-edge path is exercised."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.operators import prefix, quantiles
from sparkwright.operators.topk import top_k_per_group

from .conftest import SF001


@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"),
    )


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= 1e-6 * max(1.0, abs(b))


def test_running_multi_bucket_matches_window(orders):
    r = prefix.running(
        orders, {"cs": ("sum", "v"), "mx": ("max", "v"), "mn": ("min", "v"), "ff": ("last", "v")},
        ["o_orderkey"], rows_per_bucket=700,
    )
    w = W.orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    ref = orders.select(
        "o_orderkey",
        F.when(F.col("v").isNotNull(), F.sum("v").over(w)).alias("cs2"),
        F.when(F.col("v").isNotNull(), F.max("v").over(w)).alias("mx2"),
        F.when(F.col("v").isNotNull(), F.min("v").over(w)).alias("mn2"),
        F.last("v", True).over(w).alias("ff2"),
    )
    rows = r.join(ref, "o_orderkey").collect()
    assert len(rows) == orders.count()
    for x in rows:
        assert _close(x.cs, x.cs2) and x.mx == x.mx2 and x.mn == x.mn2 and x.ff == x.ff2


def test_running_grouped_and_date_key(orders):
    r = prefix.running(orders, {"cs": ("sum", "v")}, ["o_orderdate", "o_orderkey"], ["o_orderstatus"], rows_per_bucket=500)
    w = W.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    ref = orders.select("o_orderkey", F.when(F.col("v").isNotNull(), F.sum("v").over(w)).alias("cs2"))
    assert all(_close(x.cs, x.cs2) for x in r.join(ref, "o_orderkey").collect())


def test_text_order_key_buckets(spark, orders):
    d = orders.select(F.format_string("k%07d", "o_orderkey").alias("k"), "v")
    r = prefix.running(d, {"cs": ("sum", "v")}, ["k"], rows_per_bucket=900)
    ref = d.select("k", F.when(F.col("v").isNotNull(), F.sum("v").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))).alias("cs2"))
    assert all(_close(x.cs, x.cs2) for x in r.join(ref, "k").collect())


@pytest.mark.parametrize("periods", [1, 3, -2])
def test_lag_lead_across_buckets(orders, periods):
    r = prefix.lag(orders, "v", periods, ["o_orderkey"], rows_per_bucket=650, name="lg")
    ref = orders.select("o_orderkey", F.lag("v", periods).over(W.orderBy("o_orderkey")).alias("lg2"))
    assert r.join(ref, "o_orderkey").where(~F.col("lg").eqNullSafe(F.col("lg2"))).count() == 0


def test_rolling_mean_across_buckets(orders):
    r = prefix.rolling_mean(orders, "v", 4, ["o_orderkey"], ["o_orderstatus"], rows_per_bucket=300, name="rm")
    fr = W.partitionBy("o_orderstatus").orderBy("o_orderkey").rowsBetween(-3, 0)
    ref = orders.select("o_orderkey", F.when(F.count("v").over(fr) == 4, F.avg("v").over(fr)).alias("rm2"))
    assert all(_close(x.rm, x.rm2) for x in r.join(ref, "o_orderkey").collect())


def test_hot_group_is_split(spark, orders):
    """A group holding every row still spreads over many window partitions."""
    hot = orders.withColumn("g", F.lit("all"))
    b = prefix.add_buckets(hot, ["o_orderkey"], rows_per_bucket=1000)
    sizes = [r["count"] for r in b.groupBy("g", prefix.BUCKET).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 2000


def test_exact_quantiles_refinement(orders):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.column_quantiles(orders, ["v", "o_custkey"], probs, buckets=16, collect_limit=40)
    pdf = orders.select("v", "o_custkey").toPandas()
    for c in ["v", "o_custkey"]:
        want = np.percentile(pdf[c].dropna().astype(float), [p * 100 for p in probs])
        assert np.allclose(got[c], want, rtol=1e-12, atol=1e-9)


def test_exact_quantiles_grouped_and_constant(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", None), ("b", 5.0), ("b", float("nan")), ("c", None)],
        "g string, x double",
    )
    got = quantiles.exact_quantiles(df, ["x"], [0.5, 0.25], group_by=["g"], buckets=4, collect_limit=1)
    assert got[("a", "x")] == [1.0, 1.0]
    assert got[("b", "x")] == [3.5, 2.75]
    assert ("c", "x") not in got
    many = quantiles.grouped_quantiles(df, ["x"], [0.5, 0.25], ["g"], buckets=4, collect_limit=1)
    assert {r["g"]: r["q"] for r in many.collect()} == {"a": [1.0, 1.0], "b": [3.5, 2.75]}


def test_top_k_per_group_matches_row_number(orders):
    got = top_k_per_group(orders, ["o_orderstatus"], [F.col("o_custkey").desc(), F.col("o_orderkey")], 5, salts=7)
    w = W.partitionBy("o_orderstatus").orderBy(F.col("o_custkey").desc(), F.col("o_orderkey"))
    ref = orders.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    assert sorted(got.select("o_orderkey", "rank").collect()) == sorted(ref.select("o_orderkey", "rank").collect())


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_matches_pandas_merge_asof(spark, strict):
    import pandas as pd

    from sparkwright.operators.asof import asof_join

    rng = np.random.default_rng(4)
    left = pd.DataFrame({"k": rng.integers(0, 5, 400), "t": rng.integers(0, 1000, 400), "lid": np.arange(400)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 120), "t": rng.integers(0, 1000, 120)})
    right = right.drop_duplicates(["k", "t"]).reset_index(drop=True)
    right["rid"] = np.arange(len(right))
    want = pd.merge_asof(
        left.sort_values("t"), right.rename(columns={"t": "rt"}).sort_values("rt"), left_on="t", right_on="rt",
        by="k", direction="backward", allow_exact_matches=not strict,
    )
    l = spark.createDataFrame(left)
    r = spark.createDataFrame(right.rename(columns={"t": "rt"}))
    got = asof_join(l, r, ["k"], "t", "rt", ["rid", "rt"], strict=strict, rows_per_bucket=50).toPandas()
    m = got.set_index("lid")["rid"]
    w = want.set_index("lid")["rid"]
    assert all((pd.isna(m[i]) and pd.isna(w[i])) or m[i] == w[i] for i in left["lid"])


def _ties(spark):
    """90 % of the rows on one date, null and NaN values, null groups and keys."""
    rows = []
    for i in range(900):
        day = 5 if i % 10 else i % 7
        name = None if i % 97 == 0 else f"name-with-a-long-common-start-{i:05d}"
        v = None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i % 17)
        rows.append((i, day, name, [None, "a", "b"][i % 3], v))
    return spark.createDataFrame(rows, "id long, day int, name string, g string, v double")


@pytest.mark.parametrize("order", [["day", "id"], ["name", "id"], ["id"]])
def test_small_buckets_give_the_same_answer(spark, order):
    d = _ties(spark)
    for kw in ({"group_by": ["g"]}, {}):
        specs = {"s": ("sum", "v"), "m": ("max", "v"), "f": ("last", "v"), "c": ("count", "v")}
        one = prefix.running(d, specs, order, **kw).select("id", *specs)
        many = prefix.running(d, specs, order, rows_per_bucket=40, **kw).select("id", *specs)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
        one = prefix.lag(d, "v", 2, order, name="l", **kw).select("id", "l")
        many = prefix.lag(d, "v", 2, order, name="l", rows_per_bucket=40, **kw).select("id", "l")
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


@pytest.mark.parametrize("order", [["day", "id"], ["name"]])
def test_hot_order_value_and_common_text_start_are_split(spark, order):
    b = prefix.add_buckets(_ties(spark), order, rows_per_bucket=50)
    sizes = [r["count"] for r in b.groupBy(prefix.BUCKET).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 900
    bad = b.select("*", F.lag(prefix.BUCKET).over(W.orderBy(*order)).alias("before")).where(F.col("before") > F.col(prefix.BUCKET))
    assert bad.count() == 0


def test_quantiles_with_infinities_do_not_depend_on_limits(spark):
    inf = float("inf")
    rows = [(i % 3, float(i % 50)) for i in range(600)] + [(0, inf)] * 40 + [(1, -inf)] * 7 + [(None, 1.5), (None, -1e308), (None, 1e308), (2, 5e-324)]
    d = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    whole = {r["g"]: r["q"] for r in quantiles.grouped_quantiles(d, ["x"], probs, ["g"]).collect()}
    for limit in (1, 3, 300):
        got = quantiles.grouped_quantiles(d, ["x"], probs, ["g"], buckets=4, collect_limit=limit)
        assert {r["g"]: r["q"] for r in got.collect()} == whole
    assert whole[0][-1] == inf and whole[1][0] == -inf and set(whole) == {None, 0, 1, 2}


def test_a_group_lies_in_neighbouring_buckets(spark):
    """Small groups are not parted by buckets that run across all of them."""
    d = spark.range(4000).selectExpr("id % 400 AS g", "id * 7919 % 4001 AS o", "id")
    b, bound = prefix._bucketize(d, ["o"], rows_per_bucket=100, group_by=["g"])
    parts, buckets = b.select("g", prefix.BUCKET).distinct().count(), b.select(prefix.BUCKET).distinct().count()
    assert 40 <= buckets <= bound and parts <= 400 + buckets


def test_equal_rows_share_a_bucket_beyond_its_size(spark):
    d = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 1 WHEN id < 610 THEN NULL ELSE id END AS o", "id")
    b = prefix.add_buckets(d, ["o"], rows_per_bucket=50)
    assert b.groupBy("o").agg(F.countDistinct(prefix.BUCKET).alias("n")).where("n > 1").count() == 0
    assert b.count() == 1000 and b.select(prefix.BUCKET).distinct().count() >= 8


def test_pct_change_buckets_its_rows_once(orders, monkeypatch):
    from sparkwright.operators import features

    calls, own = [], prefix._bucketize
    monkeypatch.setattr(prefix, "_bucketize", lambda *a, **k: calls.append(1) or own(*a, **k))
    got = features.create_pct_change(orders, "v", 1, ["o_orderkey"], "o_custkey", rows_per_bucket=300)
    want = features.create_pct_change(orders, "v", 1, ["o_orderkey"], "o_custkey")
    name = "v_pct_change_1"
    both = got.join(want.select("o_orderkey", F.col(name).alias("w")), "o_orderkey")
    assert both.count() == orders.count() and both.where(~F.col(name).eqNullSafe(F.col("w"))).count() == 0
    assert len(calls) == 2 and got.columns == [*orders.columns, name]
