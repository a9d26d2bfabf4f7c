"""Cleaning, transform, feature, quality and profile operators on small literal
frames, with pandas as the second oracle (FIXTURES.md section 4)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import cleaning as C
from sparkwright.operators import features as FE
from sparkwright.operators import profile as P
from sparkwright.operators import quality as V
from sparkwright.operators import transform as X


@pytest.fixture()
def nulls_and_ties(spark):
    rows = [(1, "b", 2.0), (2, "a", 2.0), (3, None, None), (4, "b", 5.0), (5, "a", None), (6, "c", 1.0), (7, None, 2.0)]
    return spark.createDataFrame(rows, "i int, k string, v double")


@pytest.fixture()
def seq(spark):
    return spark.createDataFrame([(1, 1.0), (2, None), (3, 0.0), (4, 5.0), (5, 0.0), (6, 0.0)], "i int, v double")


def test_fill_auto_median_and_mode_ties(nulls_and_ties):
    out = C.handle_missing_values(nulls_and_ties, "auto").orderBy("i").collect()
    # median of 2, 2, 5, 1, 2 = 2 ; mode of b, a, b, a, c -> tie a / b -> smallest 'a'
    assert [r.v for r in out] == [2.0, 2.0, 2.0, 5.0, 2.0, 1.0, 2.0]
    assert [r.k for r in out] == ["b", "a", "a", "b", "a", "c", "a"]


def test_fill_auto_unknown_when_no_value(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, s string")
    assert [r.s for r in C.handle_missing_values(df, "auto").collect()] == ["Unknown", "Unknown"]


def test_ffill_dates_leading_null_stays(spark):
    import datetime as dt

    d = dt.datetime
    df = spark.createDataFrame([(1, None), (2, d(2024, 1, 2)), (3, None), (4, d(2024, 1, 5)), (5, None)], "i int, t timestamp_ntz")
    out = [r.t for r in C.handle_missing_values(df, "auto", order_by=["i"]).orderBy("i").collect()]
    assert out == [None, d(2024, 1, 2), d(2024, 1, 2), d(2024, 1, 5), d(2024, 1, 5)]


def test_duplicates_two_measures(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (None,)], "x double")
    v = V.check_duplicates(df).first()
    o = P.overview(df).first()
    assert v.duplicate_count == 4 and v.duplicate_percentage == 80.0
    assert o.duplicate_rows == 2 and o.duplicate_pct == 40.0


def test_remove_duplicates_subset_keeps_first(nulls_and_ties):
    out = C.remove_duplicates(nulls_and_ties, subset=["k"], order_by=["i"]).orderBy("i").collect()
    assert [(r.i, r.k) for r in out] == [(1, "b"), (2, "a"), (3, None), (6, "c")]


def test_outliers_sequential_vs_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.lognormal(size=400), "b": rng.standard_t(2, size=400)})
    df = spark.createDataFrame(pdf)
    exp = pdf.copy()
    for c in ["a", "b"]:
        q1, q3 = exp[c].quantile(0.25), exp[c].quantile(0.75)
        exp = exp[(exp[c] >= q1 - 1.5 * (q3 - q1)) & (exp[c] <= q3 + 1.5 * (q3 - q1))]
    got = C.remove_outliers_iqr(df, ["a", "b"]).toPandas()
    assert len(got) == len(exp)
    assert np.allclose(np.sort(got["a"]), np.sort(exp["a"]))


def test_clean_column_names_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a-b", " X! "])
    assert C.clean_column_names(df).columns == ["a_b", "a_b_1", "x"]


def test_coerce_numeric_majority(spark):
    df = spark.createDataFrame([("1,234", "5"), ("5", "x"), ("x", "y")], ["Col A", "Col B"])
    out = C.coerce_numeric_majority(df)
    assert out.columns == ["col_a", "col_b"]
    assert [r.col_a for r in out.collect()] == [1234.0, 5.0, None]
    assert dict(out.dtypes)["col_b"] == "string"


def test_convert_dtypes_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1.5", "1"), ("2", "2", "x")], "a string, b string, c string")
    t = dict(X.convert_dtypes(df).dtypes)
    assert t == {"a": "bigint", "b": "double", "c": "string"}


def test_zscore_constant_column_unchanged(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 6.0)], "c double, v double")
    out = X.normalize_numeric(df).collect()
    assert [r.c for r in out] == [3.0, 3.0, 3.0]
    pv = pd.Series([1.0, 2.0, 6.0])
    assert np.allclose([r.v for r in out], ((pv - pv.mean()) / pv.std()).tolist())


def test_bins_match_pandas_cut(spark):
    vals = [1.0, 2.0, 2.5, 4.0, 7.0, 10.0, 3.25, 5.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r["x_bin"]["bin_index"] for r in X.create_bins(df, "x", 4).orderBy("i").collect()]
    want = (pd.cut(pd.Series(vals), bins=4, labels=False) + 1).tolist()
    assert got == want


def test_rank_average_matches_pandas(spark):
    vals = [3.0, 1.0, None, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r.x_rank for r in X.rank_columns(df, ["x"], rows_per_bucket=1).orderBy("i").collect()]
    want = pd.Series(vals).rank(ascending=False).tolist()
    assert [g if g is not None else float("nan") for g in got] == pytest.approx(want, nan_ok=True)


def test_one_hot_null_row_all_false(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "c string")
    out = X.one_hot_encode(df, ["c"]).collect()
    assert [tuple(r) for r in out] == [(True, False), (False, False), (False, True)]


def test_seq_features(seq):
    pct = FE.create_pct_change(seq, "v", 1, ["i"], rows_per_bucket=2).orderBy("i")
    got = [r.v_pct_change_1 for r in pct.collect()]
    # pandas: NaN, 0, -100, inf, -100, NaN -> inf / NaN become null here
    assert got == [None, 0.0, -100.0, None, -100.0, None]
    rt = [r.v_running_total for r in FE.create_running_total(seq, "v", ["i"], rows_per_bucket=2).orderBy("i").collect()]
    assert rt == [1.0, None, 1.0, 6.0, 6.0, 6.0]
    ra = [r.v_rolling_avg_3 for r in FE.create_rolling_avg(seq, "v", 3, ["i"], rows_per_bucket=2).orderBy("i").collect()]
    want = pd.Series([1.0, None, 0.0, 5.0, 0.0, 0.0]).rolling(3).mean().tolist()
    assert [x if x is not None else float("nan") for x in ra] == pytest.approx(want, nan_ok=True)


def test_descriptive_stats_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.exponential(size=300), "b": rng.normal(size=300)})
    pdf.loc[::17, "b"] = np.nan
    got = {r.column: r for r in P.descriptive_stats(spark.createDataFrame(pdf)).collect()}
    for c in ["a", "b"]:
        s = pdf[c]
        assert got[c].skewness == pytest.approx(s.skew(), rel=1e-9)
        assert got[c].kurtosis == pytest.approx(s.kurt(), rel=1e-9)
        assert got[c].p95 == pytest.approx(s.quantile(0.95), rel=1e-12)
        assert got[c].missing == int(s.isna().sum())


def test_skew_below_minimum_n(spark):
    r = P.descriptive_stats(spark.createDataFrame([(1.0,), (2.0,)], "x double")).first()
    assert r.skewness is None and r.kurtosis is None


def test_spearman_matches_pandas_rank_corr(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 200).astype(float), "b": rng.normal(size=200)})
    pdf["c"] = pdf["a"] * 2 + rng.normal(size=200)
    got = {(r.col1, r.col2): r.corr for r in P.correlation_long(spark.createDataFrame(pdf), "spearman").collect()}
    want = pdf.rank().corr()
    assert got[("a", "c")] == pytest.approx(want.loc["a", "c"], rel=1e-9)


def test_value_counts_ties_and_unique(nulls_and_ties):
    info, top = P.value_counts(nulls_and_ties, top_n=2, columns=["k"])
    assert [(r.value, r["count"]) for r in top.orderBy("rank").collect()] == [("a", 2), ("b", 2)]
    assert info.first().unique == 3


def test_zscore_outliers_and_missing(spark):
    vals = [0.0] * 30 + [100.0]
    df = spark.createDataFrame([(v, None if i % 10 == 0 else 1) for i, v in enumerate(vals)], "x double, y int")
    o = V.check_outliers_zscore(df).collect()
    assert [(r.column, r["count"]) for r in o] == [("x", 1)]
    summary, per = V.check_missing_values(df)
    assert summary.first().total_missing == 4 and per.first().column == "y"


def test_empty_frame_percentages(spark):
    df = spark.createDataFrame([], "x double")
    assert V.check_duplicates(df).first().duplicate_percentage == 0.0
    assert P.overview(df).first().duplicate_pct == 0.0
    assert P.missing_patterns(df).count() == 0


def test_schema_compliance(spark):
    df = spark.createDataFrame([(1, "a")], "a bigint, b string")
    issues = {r.column: r.issue for r in V.check_schema_compliance(df, {"a": "int", "b": "string", "c": "double"}).collect()}
    assert issues == {"a": "expected int, got bigint", "c": "missing"}


def test_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (None, 1.0)], "n double, d double")
    assert [r.n_to_d_ratio for r in FE.create_ratios(df, "n", "d").collect()] == [2.0, 0.0, 0.0]


def test_cyclical(spark):
    df = spark.createDataFrame([(6,), (12,)], "m int")
    out = FE.encode_cyclical_features(df, "m").collect()
    assert out[1].m_sin == pytest.approx(math.sin(2 * math.pi)) and out[0].m_cos == pytest.approx(-1.0)


def test_date_features_weekday(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 6, 3),), (dt.datetime(2024, 6, 9),)], "d timestamp_ntz")
    out = X.add_date_features(df, "d").collect()
    assert (out[0].d_dayofweek, out[0].d_weekday) == (0, 1)
    assert (out[1].d_dayofweek, out[1].d_weekday) == (6, 0)


def test_declarative_unknown_operation_raises(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        X.apply_transformations(df, [{"operation": "nope"}])


def _tau_b_brute(x, y):
    from collections import Counter

    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    n1 = sum(c * (c - 1) / 2 for c in Counter(x).values())
    n2 = sum(c * (c - 1) / 2 for c in Counter(y).values())
    return s / math.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_exact_vs_brute_force(spark):
    from sparkwright.operators.kendall import dominance_count, kendall_tau

    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 40))
        a, b, w = rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n)
        brute = sum(w[i] * w[j] for i in range(n) for j in range(n) if a[i] < a[j] and b[i] < b[j])
        assert dominance_count(a, b, w) == brute
    x = rng.integers(0, 12, 300).astype(float)
    y = x * 0.3 + rng.integers(0, 7, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    want = _tau_b_brute(x, y)
    assert kendall_tau(df, "x", "y") == pytest.approx(want, rel=1e-12)
    # forced block decomposition (all four cases) gives the same value
    assert kendall_tau(df, "x", "y", points_per_task=7) == pytest.approx(want, rel=1e-12)


def test_kendall_with_a_two_valued_column_and_tiny_tasks(spark):
    from sparkwright.operators.kendall import kendall_tau

    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 2, 300), rng.permutation(300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())
    assert kendall_tau(df, "x", "y", points_per_task=60) == pytest.approx(want, rel=1e-12)


def test_kendall_long_blocked_matches_small(spark):
    from sparkwright.operators.kendall import kendall_long

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 30, 250).astype(float), "b": rng.normal(size=250), "c": rng.integers(0, 4, 250).astype(float)})
    df = spark.createDataFrame(pdf)
    small = {(r.col1, r.col2): r.corr for r in kendall_long(df, ["a", "b", "c"]).collect()}
    blocked = {(r.col1, r.col2): r.corr for r in kendall_long(df, ["a", "b", "c"], points_per_task=20).collect()}
    for k, v in small.items():
        assert blocked[k] == pytest.approx(v, rel=1e-12)
    assert small[("a", "c")] == pytest.approx(_tau_b_brute(pdf["a"].to_numpy(), pdf["c"].to_numpy()), rel=1e-12)


def test_auto_clean_parses_filled_text_dates(spark):
    import datetime as dt

    df = spark.createDataFrame(
        [(1, "2024-01-02", "x"), (2, None, "y"), (3, "2024-01-02", None), (3, "2024-01-02", None), (4, "2024-03-01", "n/a")],
        ["Key", "When", "Label"],
    )
    out, steps = C.auto_clean(df, order_by=["Key"])
    rows = out.orderBy("key").collect()
    assert dict(out.dtypes)["when"] == "timestamp_ntz" and dict(out.dtypes)["label"] == "string"
    assert [r.when for r in rows] == [dt.datetime(2024, 1, 2)] * 3 + [dt.datetime(2024, 3, 1)]
    assert len(rows) == 4 and "Parsed date columns" in steps


def test_nan_is_missing_for_ranks_counts_modes(spark):
    pdf = pd.DataFrame({"x": [1.0, np.nan, 1.0, 3.0, np.nan, 2.0]})
    df = spark.createDataFrame(pdf)
    got = [r.x_rank for r in X.rank_columns(df.withColumn("i", F.monotonically_increasing_id()), ["x"]).orderBy("i").collect()]
    want = pdf["x"].rank(ascending=False).tolist()
    assert [g if g is not None else float("nan") for g in got] == pytest.approx(want, nan_ok=True)
    info, top = P.value_counts(df, columns=["x"])
    assert info.first().unique == pdf["x"].nunique() and top.count() == 3
    assert C.column_modes(df, ["x"])["x"] == 1.0


def test_parse_timestamp_shape_dispatch_equals_trying_all_formats(spark):
    vals = [
        "2024-01-02", "2024-01-02 03:04", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02 03:04:05.123456",
        "2024/01/02", "01/02/2024", "02.01.2024", " 2024-01-02\t", "x", "2024-13-45", "1/2/2024", "+2024-01-02",
        "2024-1-2", "", None, "12/31/1999", "31.12.1999",
    ]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    s = F.trim(F.col("s"), F.lit(" \t\n\x0b\x0c\r"))
    every = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in C.DATE_FORMATS]).cast("timestamp_ntz")
    rows = df.select(C.parse_timestamp("s").alias("a"), every.alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert sum(r.a is not None for r in rows) == 11


def test_number_like_never_drops_castable_text(spark):
    from sparkwright.functions.numeric import number_like

    vals = ["NaN", "-Infinity", "+inf", "INF", " nan ", "1e3", ".5", "-7", "1,0", "x", "", "e", "1-URGENT", "0x1p3", "3d"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    s = F.trim(F.col("v"), F.lit(" \t\n\x0b\x0c\r"))
    rows = df.select(s.try_cast("double").alias("d"), number_like(s).alias("ok")).collect()
    assert all(r.ok for r in rows if r.d is not None)


def test_bins_edges_match_pandas_including_constant(spark):
    for vals in ([1.0, 2.0, 2.5, 4.0, 7.0, 10.0], [5.0, 5.0, 5.0], [0.0, 0.0]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
        rows = X.create_bins(df, "x", 3).orderBy("i").collect()
        _, edges = pd.cut(pd.Series(vals), bins=3, retbins=True)
        codes = pd.cut(pd.Series(vals), bins=3, labels=False).tolist()
        for r, code in zip(rows, codes):
            assert r["x_bin"]["bin_index"] == code + 1
            assert r["x_bin"]["lower"] == pytest.approx(edges[code], rel=1e-12, abs=1e-12)
            assert r["x_bin"]["upper"] == pytest.approx(edges[code + 1], rel=1e-12, abs=1e-12)


def test_infer_schema_order_column_named_like_internals(spark):
    df = spark.createDataFrame([(2, "b", 1.0), (1, "a", None), (3, "c", 3.0)], "column int, value string, x double")
    rows = {r.column: r for r in P.infer_schema(df, order_by=["column"]).collect()}
    assert rows["value"].sample_values == ["a", "b", "c"] and rows["x"].null_count == 1
    assert rows["column"].unique_count == 3 and rows["x"].sample_values == ["1.0", "3.0"]


def test_dominance_count_of_many_distinct_values():
    """Ties are summed by sorted runs, not by a lookup per value."""
    import time

    from sparkwright.operators.kendall import dominance_count

    m = 400_000
    a, w = np.arange(m, dtype=float), np.ones(m, dtype=np.int64)
    t0 = time.process_time()
    assert dominance_count(a, a, w) == m * (m - 1) // 2 and dominance_count(a, -a, w) == 0
    assert dominance_count(a // 2, a, w) == m * (m - 1) // 2 - m // 2
    assert time.process_time() - t0 < 12


def test_profile_of_many_columns_is_in_long_form(spark, monkeypatch):
    """Moments and correlations of 14 columns equal pandas; no aggregate has an
    expression for every column or pair."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({f"c{i}": np.where(rng.random(200) < 0.03 * i, np.nan, rng.normal(size=200) * i + 1) for i in range(1, 14)})
    frame["flat"], widths = 3.0, []
    from pyspark.sql import GroupedData

    own = GroupedData.agg
    monkeypatch.setattr(GroupedData, "agg", lambda g, *e: widths.append(len(e)) or own(g, *e))
    df = spark.createDataFrame(frame)
    got = {(r.col1, r.col2): r.corr for r in P.correlation_long(df).collect()}
    want = frame.corr()
    for (a, b), v in got.items():
        assert a == b or v is None or v == pytest.approx(want.loc[a, b], abs=1e-12), (a, b)
    assert sum(v is None for v in got.values()) == 26 and len(got) == 196
    mom = P._moments(df, list(frame))
    assert widths and max(widths) <= 8
    for c in frame:
        assert mom[c]["count"] == frame[c].count() and mom[c]["rows"] == 200 and mom[c]["mean"] == pytest.approx(frame[c].mean())
        assert mom[c]["std"] == pytest.approx(frame[c].std())
    none = P._moments(df.limit(0), ["c1"])["c1"]
    assert none["rows"] == none["count"] == 0 and none["mean"] is None
