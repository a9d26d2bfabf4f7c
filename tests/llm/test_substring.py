import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import substring
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, docs_frame, documents, words


def brute(rows, window=35):
    tokens = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, tokens):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc.doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op8_substring_dedup"](spark, SF).collect()), key=repr)
    assert got == brute(list(documents().items()))


@pytest.mark.parametrize("seed,batch", [(1, 1 << 20), (2, 900)])
def test_planted_passages(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    rng = random.Random(seed)
    words_ = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words_) for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(60):
        w = [rng.choice(words_) for _ in range(rng.randrange(0, 90))]
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(99, "a b " * 60), (100, None), (101, ""), (102, " \n "), (None, rows[3][1]), (None, "é " * 40), (5, rows[5][1]), (5, "other text")]
    rows += [(103, " ".join(f"v{i}" for i in range(60_000))), (104, " ".join(f"v{i}" for i in range(59_000, 59_060)))]
    df = docs_frame(spark, rows).withColumns({c: F.lit(7) for c in ("i", "x", "doc", "cuts", "edges", "a")})
    assert collected(substring.dedup(df)) == brute(rows)


def test_text_keeps_its_other_words_and_spaces(spark):
    run = " ".join(f"r{i}" for i in range(40))
    rows = [(1, f"one  two\n{run}\nthree\tfour "), (2, f"{run}"), (3, " untouched  text ")]
    got = {r["doc"]["doc_id"]: r["text"] for r in substring.dedup(docs_frame(spark, rows)).collect()}
    assert got == {1: "one  two\nthree\tfour", 2: "", 3: " untouched  text "}


def test_values_meet_across_small_batches(spark):
    """One row per Arrow batch: a value's rows come one by one."""
    rng = random.Random(9)
    moved, want = [], {}
    for h in range(40):
        kinds = [rng.choice(["one", "one", "seen", "settled"]) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
        for n, kind in enumerate(kinds):
            place = rng.randrange(1000)
            run = {"one": place << 32 | place, "seen": substring._SEEN, "settled": ~(place << 32 | place + 3)}[kind]
            moved.append((h, h % 3, h * 100 + n, 1, run))
            weight = sum({"one": 1, "seen": 2, "settled": 0}[k] for k in kinds)
            if kind == "settled" or (kind == "one" and weight > 1):
                want[h * 100 + n] = [place << 32 | place + (3 if kind == "settled" else 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = substring._meet(spark.createDataFrame(moved, substring._MOVED), "runs").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["i"]: r["runs"] for r in got} == want


def test_empty_table(spark):
    assert substring.dedup(docs_frame(spark, [])).collect() == []


def test_minimizers_are_the_leftmost_smallest():
    w = substring.Words([b"a b a b a b c d e f g h a b c d e f g h i j", b"x y"])
    grams = w.grams(3, substring._ODD[1])
    got = w.minimizers(3, 7)
    for i, p in enumerate(got):
        own = grams[i : i + 5].tolist()
        assert p == i + own.index(min(own))


def test_copies_without_ids_share_their_runs(spark):
    """50,000 equal rows: the runs of a document do not grow with its copies."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    other = docs_frame(spark, [(1, text + " and one more"), (2, "left alone")])
    got = substring.dedup(rows.unionByName(other).repartition(8)).groupBy("doc.doc_id", "n_removed", "text").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["text"], r["count"]) for r in got) == [
        (0, 60, "", 50_000), (1, 60, "and one more", 1), (2, 0, "left alone", 1)]
