import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import rules
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, words


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def brute(rows):
    """Counts, then one determinant estimate per group with numpy."""
    counts = [brute_counts(t) for _, t, _, _ in rows]
    groups = defaultdict(list)
    for at, (_, _, lang, source) in enumerate(rows):
        if not counts[at][5]:
            groups[lang, source].append(at)

    def vector(c):
        n, chars = max(c[0], 1), max(c[1], 1)
        x = [math.log(chars / n), math.log1p(100 * c[2] / chars), math.log1p(c[3]), math.log1p(100 * c[4] / n), math.log(n)]
        return [round(v * 1024) for v in x]

    floors = np.array([0.15, 0.35, 1.0, 1.0, 1.5]) * 1024
    far = {}
    for at in groups.values():
        x = np.array([vector(counts[i]) for i in at], float)
        mean, inverse = np.median(x, axis=0), np.diag(1 / floors**2)
        for _ in range(5):
            d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
            bins = np.floor(16 * np.log2(1 + d))
            edge = np.sort(bins)[math.ceil(0.5 * len(x)) - 1]
            sub = x[bins <= edge]
            mean = sub.mean(axis=0)
            cov = (sub - mean).T @ (sub - mean) / len(sub) * 1.9122080585129484  # 0.5 / F7(F5^-1(0.5))
            inverse = np.linalg.inv(cov + np.diag(floors**2))
        for i, v in zip(at, np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)):
            far[i] = v
    out = [(rows[i][0], *counts[i], i in far and bool(far[i] <= 31.0)) for i in range(len(rows))]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", *RULES).collect()), key=repr)


RULES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert collected(QUERIES["op7_quality_rules"](spark, SF)) == brute(rows)


def test_edge_rows(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(i, prose + f" more{i}", "en", "s") for i in range(30)]
    rows += [
        (100, None, "en", "s"), (101, "", "en", "s"), (102, " \t\n ", None, None), (103, "a b c d e " * 3, "en", "s"),
        (104, " ".join(f"### w{i}" for i in range(30)), "en", "s"), (105, prose, None, "s"), (105, prose, None, "s"),
        (None, prose, "en", None), (106, " ".join(f"x{i}" for i in range(20_000)), "en", "s"),
        (107, f"{prose}\n{prose}\n\n \n{prose}", "de", "t"), (108, "é ü 한　국 " * 4 + prose, "de", "t"),
        (109, "a b c d e " + prose + " a b c d e f", "de", "t"), (110, "x " * 10, "de", "t"), (111, "q w e r t q w e r t", "de", "t"),
    ]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, lang string, source string, n int, by0 int, bin int")
    got = collected(rules.quality_rules(df))
    assert got == brute(rows)
    kept = {r[0] for r in got if r[-1]}
    assert {0, 29, 105, 106} <= kept and 104 not in kept


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rules.quality_rules(df).collect() == []


@pytest.mark.parametrize("share", [0.5, 0.75])
def test_consistency_factor(share):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200_000, 5))
    d = (x**2).sum(axis=1)
    sub = x[d <= np.quantile(d, share)]
    assert abs(rules._consistency(share) * sub.var() - 1) < 0.02


def test_query_runs_no_python_on_executors(spark):
    plan = QUERIES["op7_quality_rules"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labelled_quality(spark):
    """What the rules reject is what labels.quality marks, and little else."""
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op7_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = got.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict((q, v) for q, v in r)
    assert share[1] > 0.95 and share[0] < 0.15


def test_forty_percent_of_a_group_can_be_outliers(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1000):
        w = [f"w{k}" for k in rng.integers(0, 5000, int(rng.lognormal(5, 0.5)) + 12)]
        if i % 5 < 2:  # junk: symbols in every third word
            w = [x + "#$%" if k % 3 == 0 else x for k, x in enumerate(w)]
        rows.append((i, " ".join(w), "en", "hot"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(df).select("doc_id", "kept").collect()}
    assert not any(got[i] for i in range(1000) if i % 5 < 2)
    assert np.mean([got[i] for i in range(1000) if i % 5 >= 2]) > 0.93
