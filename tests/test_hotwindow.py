"""Windows over hot partitions against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwright.operators import hotwindow as H
from sparkwright.operators.hotwindow import Fn

ALL = {
    "rn": Fn("row_number"), "rk": Fn("rank"), "dr": Fn("dense_rank"), "pr": Fn("percent_rank"), "cd": Fn("cume_dist"),
    "n4": Fn("ntile", n=4), "n7": Fn("ntile", n=7), "n9999": Fn("ntile", n=9999),
    "s_rows": Fn("sum", "v", frame="rows"), "s_range": Fn("sum", "v"), "s_all": Fn("sum", "v", frame="partition"),
    "a_rows": Fn("avg", "v", frame="rows"), "a_all": Fn("avg", "v", frame="partition"), "m3": Fn("avg", "v", frame=(2, 0)),
    "mn": Fn("min", "v", frame="rows"), "mx": Fn("max", "v", frame="range"), "c": Fn("count", "v", frame="rows"),
    "mx_all": Fn("max", "v", frame="partition"), "c5": Fn("count", "v", frame=(2, 2)), "f": Fn("first", "v"), "l": Fn("last", "v"),
    "lag2": Fn("lag", "v", n=2), "lead1": Fn("lead", "v"),
}
TIED = {k: ALL[k] for k in ("rk", "dr", "pr", "cd", "s_range", "s_all", "a_all", "mx", "mx_all")}


def plain(df, keys, order, functions):
    spec = Window.partitionBy(*keys)
    return df.select("*", *[f.over(spec.orderBy(*order), spec).alias(n) for n, f in functions.items()])


def rows(df):
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    keys = ["hot"] * 1500 + [None] * 700 + ["a", "b", "c"] * 30
    out = [(k, rng.choice([None, *range(40)]), rng.choice(["x", "yy", "é", None]), i, rng.choice([None, rng.randrange(100)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(out, "g string, o int, t string, id long, v long").repartition(6).cache()


@pytest.mark.parametrize("order", [["o", "id"], [("o", "desc"), "t", ("id", "desc")], [("t", "desc"), "id"]])
def test_all_functions(data, order):
    sorting = [F.col(o) if isinstance(o, str) else F.desc(o[0]) for o in order]
    assert rows(H.window(data, ["g"], order, ALL, rows_per_bucket=100)) == rows(plain(data, ["g"], sorting, ALL))


def test_ties_share_a_bucket(data):
    got = H.window(data, ["g"], [("o", "desc")], TIED, rows_per_bucket=60)
    assert rows(got) == rows(plain(data, ["g"], [F.desc("o")], TIED))


def test_whole_table_is_one_partition(data):
    assert rows(H.window(data, [], ["id"], ALL, rows_per_bucket=300)) == rows(plain(data, [], [F.col("id")], ALL))


def test_two_key_columns_and_bucket_size(data):
    want = rows(plain(data, ["g", "t"], [F.col("o"), F.col("id")], ALL))
    for n in (50, 400, 10**6):
        assert rows(H.window(data, ["g", "t"], ["o", "id"], ALL, rows_per_bucket=n)) == want


def test_hot_key_spreads_over_tasks(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id < 10000 THEN 0 ELSE id END AS g", "id * 7919 % 20011 AS o", "id AS v")
    keyed = df.join(H.hot_keys(df, ["g"], 500), F.col("g").eqNullSafe(F.col("__g_g")))
    buckets, _ = H.prefix._bucketize(*H._keyed(keyed, ["g"], [("o", False)]), rows_per_bucket=500)
    sizes = [r["count"] for r in buckets.groupBy("g", H.BUCKET).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) > 15 and max(sizes) <= 1000
    plan = H.window(df, ["g"], ["o"], {"rk": Fn("rank"), "s": Fn("sum", "v", frame="rows")}, 500)._jdf.queryExecution().toString()
    assert H.BUCKET in plan and "SinglePartition" not in plan


def test_no_hot_key_is_the_plain_window(data):
    plan = H.window(data, ["g"], ["id"], {"rk": Fn("rank")})._jdf.queryExecution().toString()
    assert H.BUCKET not in plan


def test_empty_and_wrong_arguments(spark, data):
    assert H.window(data.limit(0), ["g"], ["o"], ALL, 1).collect() == []
    for wrong in (lambda: Fn("median", "v"), lambda: Fn("sum"), lambda: Fn("ntile", n=0), lambda: Fn("sum", "v", frame="groups")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        H.window(data, ["g"], ["o"], {"v": Fn("rank")})
    with pytest.raises(ValueError):
        H.window(data, ["g"], [], {"r": Fn("rank")})


def test_text_keys_are_ordered_by_spark_and_bucketed_once(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CAST(id % 2 AS INT) AS g", "concat('a common start of many bytes ', id * 7919 % 3001) AS o", "id AS v")
    calls, own = [], H.prefix._bucketize
    monkeypatch.setattr(H.prefix, "_bucketize", lambda *a, **k: calls.append(1) or own(*a, **k))
    fns = {"rk": Fn("rank"), "s": Fn("sum", "v", frame="rows"), "two": Fn("lag", "v", n=2)}
    got = H.window(df, ["g"], [("o", "desc")], fns, 100)
    assert rows(got) == rows(plain(df, ["g"], [F.col("o").desc()], fns)) and len(calls) == 1
