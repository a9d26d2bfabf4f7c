"""Spearman correlation over the rows that a pair of columns shares."""

import decimal

import numpy as np
import pandas as pd
import pytest

from sparkwright.operators import profile as P


def corr(df, cols=None, **kw):
    return {(r.col1, r.col2): r.corr for r in P.correlation_long(df, "spearman", cols, **kw).collect()}


def nullable(n=400, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    frame = pd.DataFrame({
        "a": np.where(rng.random(n) < 0.2, np.nan, a),
        "b": np.where(rng.random(n) < 0.3, np.nan, np.round(a + rng.normal(size=n), 1)),
        "whole": rng.integers(0, 9, n).astype(float),
        "tied": np.where(rng.random(n) < 0.4, np.nan, rng.integers(0, 3, n)),
    })
    return frame


@pytest.mark.parametrize("kw", [{}, {"rows_per_bucket": 7}])
@pytest.mark.parametrize("sets", [0, 99])
def test_equals_pandas_on_nullable_columns(spark, monkeypatch, kw, sets):
    monkeypatch.setattr(P, "WIDE_ROW_SETS", sets)
    frame = nullable()
    got, want = corr(spark.createDataFrame(frame), **kw), frame.corr(method="spearman")
    for (x, y), v in got.items():
        assert v == pytest.approx(want.loc[x, y], abs=1e-12), (x, y)
    assert len(got) == 16


def test_pairs_are_grouped_by_their_rows(spark):
    rows = [(1, 2, 3, None), (1, 2, None, None), (4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    pairs = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]
    assert P._pairs_by_rows(df, list("abcd"), pairs) == [[("a", "b")], [("a", "c"), ("b", "c")], [("a", "d"), ("b", "d"), ("c", "d")]]


def test_only_pairs_that_miss_rows_are_ranked_anew(spark):
    frame = nullable()
    frame["twin"] = frame["a"] ** 3  # missing on the same rows as a
    df = spark.createDataFrame(frame).select(*[P.value_or_null(spark.createDataFrame(frame), c).alias(c) for c in frame])
    pairs = [("a", "twin"), ("a", "b"), ("a", "whole"), ("twin", "whole")]
    assert P._pairs_with_own_ranks(df, list(frame), pairs) == [("a", "b"), ("a", "whole"), ("twin", "whole")]
    assert corr(spark.createDataFrame(frame), ["a", "twin"])["a", "twin"] == pytest.approx(1.0)


def test_types_keep_close_values_apart(spark):
    rows = [
        (2**60 + i, decimal.Decimal(10) ** 25 + i * i % 7, decimal.Decimal(i * i % 11) / 100, float(i % 5) if i % 4 else None)
        for i in range(60)
    ]
    rows += [(None, decimal.Decimal(-3), None, -0.0), (-(2**62), decimal.Decimal(-(10**30)), decimal.Decimal("-1.25"), None)]
    df = spark.createDataFrame(rows, "big long, wide decimal(38,2), small decimal(7,2), x double")
    names = ["big", "wide", "small", "x"]
    order = [{v: i for i, v in enumerate(sorted({r[k] for r in rows if r[k] is not None}))} for k in range(4)]
    codes = pd.DataFrame([[np.nan if v is None else float(order[k][v]) for k, v in enumerate(r)] for r in rows], columns=names)
    want = codes.corr(method="spearman")
    for (a, b), v in corr(df).items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-12), (a, b)


def test_constant_and_disjoint_pairs(spark):
    rows = [(1.0, 5.0, None, 1.0), (2.0, 5.0, None, float("nan")), (3.0, 5.0, 2.0, None), (4.0, None, 1.0, None)]
    got = corr(spark.createDataFrame(rows, "a double, b double, c double, d double"))
    assert got["a", "c"] == pytest.approx(-1.0) and got["a", "b"] is None and got["c", "d"] is None and got["b", "c"] is None


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, None)], "a double, b int")
    assert corr(df)["a", "b"] is None and corr(df.limit(0))["a", "b"] is None


def test_many_sets_of_rows_are_ranked_in_one_pass(spark, monkeypatch):
    """Six pairs over six sets of rows: no long form of all pairs, one running count."""
    monkeypatch.setattr(P, "_pairwise_spearman", None)
    calls, own = [], P.prefix.running
    monkeypatch.setattr(P.prefix, "running", lambda *a, **k: calls.append(1) or own(*a, **k))
    frame = nullable()
    frame["whole"] = np.where(np.arange(len(frame)) % 7 == 0, np.nan, frame["whole"])
    got, want = corr(spark.createDataFrame(frame), rows_per_bucket=25), frame.corr(method="spearman")
    assert len(calls) == 1
    for (x, y), v in got.items():
        assert v == pytest.approx(want.loc[x, y], abs=1e-12), (x, y)
