import corpus_pipeline
from sparkwright.llm import toxicity

from . import test_lines, test_packing, test_simhash, test_substring
from .helpers import SF

SMALL = SF


def test_stages_equal_brute_force_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables[name] = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tables[name].columns == columns
    rows = {n: {r["doc_id"]: r for r in t.collect()} for n, t in tables.items() if n != "best_fit_packing"}

    model = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    clean = {i for i, r in before.items() if model.probabilities(r["text"]).sum() < toxicity.REJECT}
    assert set(rows["toxicity"]) == clean and len(clean) < len(before)
    assert all(rows["toxicity"][i] == before[i] for i in clean)

    at = rows["toxicity"]
    want = {i: t for i, t, _, _ in test_lines.brute([(i, r["text"], r["source"]) for i, r in at.items()])}
    assert {i: r["text"] for i, r in rows["line_dedup"].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in rows["line_dedup"].items() if r["text"] != at[i]["text"])

    at = rows["line_dedup"]
    groups = test_simhash.brute([(i, r["text"]) for i, r in at.items()])
    assert set(rows["simhash_near_dedup"]) == {i for i, _, c in groups if i == c}
    assert all(rows["simhash_near_dedup"][i] == at[i] for i in rows["simhash_near_dedup"])

    at = rows["simhash_near_dedup"]
    counts = {i: (n, gone) for i, n, gone, _ in test_substring.brute([(i, r["text"]) for i, r in at.items()])}
    got = rows["substring_dedup"]
    assert set(got) == set(at)
    assert {i: len(r["text"].split()) for i, r in got.items()} == {i: n - gone for i, (n, gone) in counts.items()}
    assert any(gone for _, gone in counts.values())

    test_packing.check(
        tables["best_fit_packing"].collect(), [(i, r["text"]) for i, r in got.items()]
    )


def test_run_applies_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_columns_of_other_names_and_nulls_pass_through(spark, tmp_path):
    rows = [
        (1, "some words of a text", None, "s", 20, "kept"), (1, "some words of a text", None, "s", 20, "kept"), (2, None, "en", None, None, None),
        (None, "", "en", "s", 0, "x"), (3, "w " * 30_000, "en", "s", 60_000, "long"), (4, "other words here", "en", "s", 1, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, run string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "run"]
    ids = [r["doc_id"] for r in docs.collect()]
    assert {1, 2, 4} <= set(ids) and None in ids


def test_copies_stand_once_after_both_dedup_stages(spark, tmp_path):
    """Repeated rows and null-id copies of texts longer than a window."""
    named, unnamed, alone = (" ".join(f"{w}{i}" for i in range(60)) for w in ("first", "second", "third"))
    rows = [(1, named), (1, named), (2, named), (None, named), (None, unnamed), (None, unnamed), (None, unnamed), (3, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("simhash_near_dedup", "substring_dedup"):
        stages[name](spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted([(1, named), (None, unnamed), (3, alone)], key=repr)
