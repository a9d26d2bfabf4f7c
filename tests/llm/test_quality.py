import zlib

import numpy as np
import pytest

from sparkwright.llm import quality
from sparkwright.llm.workloads import QUERIES

SF = "/root/testdata/sf0.1"


def auc(scores, marks):
    order = np.argsort(np.argsort(scores))
    n1 = marks.sum()
    return (order[marks == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(marks) - n1))


def test_held_out_rows_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op4_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    s, y = got["score"].to_numpy(), got["quality"].to_numpy()
    assert auc(s, y) >= 0.97
    assert (got["predicted"][y == 1] == 1).mean() >= 0.98
    assert (got["predicted"][y == 0] == 0).mean() >= 0.6


def test_labels_of_held_out_rows_and_negatives_teach_nothing(spark):
    sf = SF.replace("0.1", "0.001")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    base = sorted(map(tuple, quality.classify(docs, labels).collect()))
    assert [h for i, h, _, _ in base] == [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in base]
    other = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality WHEN quality = 0 THEN NULL ELSE quality END AS quality"
    )
    assert sorted(map(tuple, quality.classify(docs, other).collect())) == base
    assert all(p == (s >= 0.3) and 0 <= s <= 1 for _, _, s, p in base)


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_prior_is_estimated_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(1)
    n = 8000
    width = len(quality.NAMES)
    positive = rng.standard_normal((n, width))
    mixed = rng.standard_normal((n, width))
    mixed[: int(n * (1 - share))] += np.array([3.0, 3.0] + [0.0] * (width - 2))
    model = quality.fit(positive, mixed)
    assert abs(model.prior - share) < 0.06
    s = model.score(mixed)
    y = np.arange(n) >= int(n * (1 - share))
    assert auc(s, y.astype(int)) > 0.95 and abs(s.mean() - share) < 0.08


def test_risk_of_negatives_stays_non_negative():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, len(quality.NAMES)))
    model = quality.fit(x[:20], x[20:], prior=0.9, l2=0.0, steps=3000)
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 60


def test_statistics():
    x = dict(zip(quality.NAMES, quality.statistics(b"Aa bb bb ##\nAa bb bb ##\n\n 1!")))
    assert x["words"] == pytest.approx(np.log(10)) and x["word_bytes"] == pytest.approx(18 / 9)
    assert x["marks"] == pytest.approx(4 / 18) and x["upper"] == pytest.approx(2 / 18)
    assert x["neighbours"] == pytest.approx(2 / 9) and x["line_copies"] == pytest.approx(1 / 3)
    assert quality.statistics(None) == quality.statistics(b" \n") == [0.0] * len(quality.NAMES)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "same text"), (3, "same text"), (4, "word " * 60_000), (6, "## " * 50)]
    docs = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, text string, x int, score double")
    for marks in ([], [(1, 1), (2, 1), (3, 1), (3, 1), (4, None), (None, 1), (77, 1)]):
        labels = spark.createDataFrame([(*r, 1) for r in marks], "doc_id long, quality int, toxic int")
        got = quality.classify(docs, labels).collect()
        assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in rows)
        assert all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
        assert quality.classify(docs.limit(0), labels).collect() == []


def pu_rows(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.standard_normal((n, len(quality.NAMES))))
    x[: n // 3] += 2.0 * (np.arange(len(quality.NAMES)) < 2)
    return x


def teaching(spark, x, parts):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def test_sums_over_spark_equal_local_ones_however_dealt(spark, monkeypatch):
    monkeypatch.setattr(quality, "LOCAL_ROWS", 0)
    x = pu_rows()
    edges = [quality.all_edges(teaching(spark, x, n)) for n in (1, 7)]
    assert all((a == b).all() for a, b in zip(*edges))
    cells = quality.PuModel(edges[0], np.zeros(1), 0.5).cells(x)
    w = np.random.default_rng(1).standard_normal(sum(len(e) + 1 for e in edges[0]) + 1)
    local = quality.LocalRows(cells, quality._starts(edges[0]))
    for n in (1, 7):
        rows = quality.binned(teaching(spark, x, n), edges[0])
        for a, b in zip(rows.sums(w), local.sums(w)):
            assert (a == b).all()
        halves = [rows.sums(w, h) for h in (0, 1)]
        assert all((a + b == c).all() for a, b, c in zip(*halves, local.sums(w)))
        at = np.array([-2.0, 0.0, 1.5])
        both = rows.above(w, at, 0) + rows.above(w, at, 1)
        assert both.tolist() == [(w[cells].sum(1) > t).sum() for t in at]


def test_scores_do_not_depend_on_partitions_and_use_all_rows(spark, monkeypatch):
    sf = SF.replace("0.1", "0.001")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = sorted(map(tuple, quality.classify(docs.repartition(3), labels.repartition(2)).collect()))
    with monkeypatch.context() as m:
        m.setattr(quality, "LOCAL_ROWS", 0)  # every sum a Spark job
        assert a == sorted(map(tuple, quality.classify(docs.repartition(8), labels.repartition(5)).collect()))
    less = sorted(map(tuple, quality.classify(docs.where("crc32(cast(doc_id as string)) % 7 > 0 or crc32(cast(doc_id as string)) % 5 = 0"), labels).collect()))
    assert {r[0]: r[2] for r in a} != {r[0]: r[2] for r in less}


def test_fit_equals_a_plain_refit():
    """The penalised risk written out per row, descended by its own gradient."""
    x = pu_rows(400)
    positive, prior, l2 = x[250:], 0.7, 0.5
    model = quality.fit(positive, x, prior=prior, l2=l2)
    cu, cp = model.cells(x), model.cells(positive)
    width = len(model.weights)
    held = np.zeros((width, width))
    first = 0
    for e in model.edges:
        for b in range(first, first + len(e) + 1):
            held[b, b] += quality.RIDGE
            if b > first:
                held[b, b] += 1
                held[b - 1, b - 1] += 1
                held[b, b - 1] -= 1
                held[b - 1, b] -= 1
        first += len(e) + 1

    def onehot(cells):
        return np.stack([np.bincount(r, minlength=width) for r in cells]).astype(float)

    u, p = onehot(cu), onehot(cp)
    risk = lambda w: np.logaddexp(0, u @ w).mean() - prior * (p @ w).mean() + l2 * w @ held @ w / 2
    w = np.zeros(width)
    for _ in range(20_000):
        w -= 0.1 * (u.T @ (1 / (1 + np.exp(-u @ w))) / len(u) - prior * p.mean(0) + l2 * held @ w)
    negatives = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    assert negatives > 0  # so the clipped risk is this one
    assert risk(model.weights) == pytest.approx(risk(w), abs=2e-5)
    assert np.abs(model.score(x) - 1 / (1 + np.exp(-u @ w))).max() < 0.02


def test_risk_of_negatives_ends_at_zero_or_above():
    x = pu_rows(600, 8)
    model = quality.fit(x[450:], x, prior=0.95, l2=1e-4)
    zu, zp = (model.weights[model.cells(v)].sum(1) for v in (x, x[450:]))
    assert np.logaddexp(0, zu).mean() - 0.95 * np.logaddexp(0, zp).mean() >= -1e-6


def test_score_at_the_threshold_is_predicted(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words"), (2, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(77, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "THRESHOLD", 0.5)  # without positives every score is 0.5
    assert [(r["score"], r["predicted"]) for r in quality.classify(docs, labels).collect()] == [(0.5, 1)] * 2
