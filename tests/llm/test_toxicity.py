import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import toxicity
from sparkwright.llm.workloads import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_toxic_documents_are_caught_and_clean_ones_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs, model).select("doc.doc_id", "rejected").join(labels.where(held), "doc_id")
    share = {r["toxic"]: r["s"] for r in got.groupBy("toxic").agg(F.avg(F.col("rejected").cast("int")).alias("s")).collect()}
    assert share[1] >= 0.9 and share[0] <= 0.01


def test_query_scores_every_row(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["severity"] <= 2 and r["rejected"] == (r["severity"] >= toxicity.REJECT) for r in got)


def test_severity_follows_ordered_grades(spark):
    words = ["mild", "harsh", "vile"]
    rows, marks = [], []
    for i in range(400):
        grade = i % 4
        rows.append((i, f"plain text number {chr(97 + i % 26)} " + " ".join(words[:grade])))
        marks.append((i, grade))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).select("doc.doc_id", "severity", "grade").collect()}
    assert sum(got[i]["grade"] == g for i, g in marks) >= 390
    means = [np.mean([got[i]["severity"] for i, g in marks if g == k]) for k in range(4)]
    assert all(b - a > 0.5 for a, b in zip(means, means[1:]))


def test_fit_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    n, width = 300, 5
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.5)
    grades = np.digitize(x @ [2, -1, 3, 0, 1] + rng.logistic(size=n) * 0.3, [1.0, 2.5])
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, width, steps=3000)

    def loss(w, cuts):
        above = np.column_stack([np.ones(n), 1 / (1 + np.exp(cuts - (x @ w)[:, None])), np.zeros(n)])
        return -np.log((above[:, :-1] - above[:, 1:])[np.arange(n), grades]).sum() + 0.25 * (w**2).sum()

    base = loss(w, cuts)
    for k in range(width):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(width) == k), cuts) > base - 1e-3
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, cuts + step * (np.arange(2) == k)) > base - 1e-3


EDGES = [(1, None), (2, ""), (None, "stupid idiot"), (3, "calm words"), (3, "calm words"), (4, "word " * 60_000), (5, "\x00 ü 한")]


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, None)], [(3, 0), (4, 1), (4, 1), (None, 1), (99, 1)]])
def test_edge_rows(spark, marks):
    docs = spark.createDataFrame([(*r, 1, "x") for r in EDGES], "doc_id long, text string, grade int, doc string")
    labels = spark.createDataFrame([(*r, 5) for r in marks], "doc_id long, toxic int, text int")
    got = toxicity.rate(docs, labels).collect()
    assert sorted((r["doc"]["doc_id"] or 0, r["doc"]["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in EDGES)
    assert toxicity.rate(docs.limit(0), labels).collect() == []


def test_small_sample_rejects_like_all_labels(spark):
    """A word in 20 % of toxic and 10 % of clean texts, ten clean to one toxic:
    no reason to reject, whatever the sample."""
    rows, marks = [], []
    for i in range(4400):
        toxic = i % 11 == 0
        worded = (i // 11) % (5 if toxic else 10) == 0
        rows.append((i, f"plain text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" + " harsh" * worded))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    clean = labels.where("toxic = 0")
    shares, severities = [], []
    for sample in (10_000, 300):
        model = toxicity.train(docs, labels, sample=sample)
        got = toxicity.score(docs, model).select("doc.doc_id", "severity", "rejected").join(clean, "doc_id")
        share, severity = got.agg(F.avg(F.col("rejected").cast("int")), F.avg("severity")).first()
        shares.append(share)
        severities.append(severity)
    assert abs(shares[1] - shares[0]) < 0.02
    assert abs(severities[1] - severities[0]) < 0.05


def repeated_ids(spark):
    """200 labels with 50 texts each, of which some hold the telling word."""
    rows = [(i % 200, f"plain {chr(97 + i % 26)} words {chr(97 + i // 26 % 26)}" + " harsh" * (i % 200 < 60 and i // 200 % 3 > 0)) for i in range(10_000)]
    marks = [(i, int(i < 60)) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_model_does_not_depend_on_partitions(spark):
    docs, labels = repeated_ids(spark)
    a, b, c = (toxicity.train(docs.repartition(n), labels.repartition(m), sample=20) for n, m in ((3, 2), (8, 5), (1, 1)))
    for other in (b, c):
        assert a.features.index == other.features.index and (a.cuts == other.cuts).all() and (a.weights == other.weights).all()


def test_one_text_of_an_id_teaches(spark):
    docs, labels = repeated_ids(spark)
    first = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    a, b = toxicity.train(docs, labels), toxicity.train(first, labels)
    assert (a.cuts == b.cuts).all() and (a.weights == b.weights).all()


def test_severity_at_the_limit_is_rejected(spark):
    model = toxicity.OrdinalModel([], np.zeros(0), np.array([np.log(1 / toxicity.REJECT - 1)]))
    docs = spark.createDataFrame([(i, "words") for i in range(9)], "doc_id long, text string")
    tied = float(model.probabilities("words").sum())
    got = toxicity.score(docs, model, reject=tied).collect()
    assert all(r["rejected"] and r["severity"] == tied for r in got)
    assert not any(r["rejected"] for r in toxicity.score(docs, model, reject=np.nextafter(tied, 1)).collect())


def test_fit_equals_a_plain_refit():
    """The same penalised likelihood, descended plainly by numeric gradients."""
    rng = np.random.default_rng(4)
    n, width = 90, 3
    x = rng.poisson(1.0, (n, width))
    grades = np.digitize(x @ [1.5, -1.0, 0.2] + rng.logistic(size=n), [0.5, 2.5])
    rows, cols = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(rows, cols, x[rows, cols].astype(float), grades, width, steps=3000)

    def loss(p):
        c = np.array([p[width], p[width] + np.logaddexp(0, p[width + 1])])
        above = np.column_stack([np.ones(n), 1 / (1 + np.exp(c - (x @ p[:width])[:, None])), np.zeros(n)])
        return -np.log((above[:, :-1] - above[:, 1:])[np.arange(n), grades]).sum() + 0.25 * (p[:width] ** 2).sum()

    p, rate = np.zeros(width + 2), 0.1
    for _ in range(3000):
        g = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in 1e-5 * np.eye(width + 2)])
        while loss(p - rate * g) > loss(p):
            rate /= 2
        p = p - rate * g
    assert np.allclose(weights, p[:width], atol=0.02)
    assert np.allclose(cuts, [p[width], p[width] + np.logaddexp(0, p[width + 1])], atol=0.02)
