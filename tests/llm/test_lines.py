import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq
from sparkwright.llm import lines
from sparkwright.llm.workloads import QUERIES

from .helpers import SF

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_sites=10, keep_first=True):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for p, x in enumerate(t.split("\n") if t is not None else []):
            if x.strip(BLANK):
                sites[x.strip(BLANK)].add(s)
                at = (i, p)
                first[x.strip(BLANK)] = min(first.get(x.strip(BLANK), at), at)
    boiler = {x for x, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for i, t, _ in rows:
        own = t.split("\n") if t is not None else []
        gone = [x.strip(BLANK) in boiler and not (keep_first and first[x.strip(BLANK)] == (i, p)) for p, x in enumerate(own)]
        out.append((i, None if t is None else "\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc.doc_id", "text", "n_lines", "n_removed").collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = sorted((tuple(r) for r in QUERIES["op9_line_dedup"](spark, SF).collect()), key=repr)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, m in brute(rows)), key=repr)
    assert any(r[2] for r in got)


def test_spread_near_and_far_from_the_threshold(spark):
    rows = []
    for n in (1, 5, 9, 10, 11, 13, 14, 20, 200):  # sites of the line
        rows += [(n * 1000 + k, f" line on {n}\t\nown {n} {k}\n\n", f"site{k}") for k in range(n)]
        rows += [(n * 1000 + 500 + k, f"line on {n}", f"site{k % n}") for k in range(30)]
    rows += [(1, None, "site1"), (2, "", "site2"), (3, " \n\t", "site3"), (4, "line on 20\nline on 20", None)]
    rows += [(300_000 + k, "no site", None) for k in range(30)] + [(300_100 + k, "no site", f"s{k}") for k in range(9)]
    rows += [(400_000, "long " * 20_000 + "\nline on 200", "site1")]
    df = spark.createDataFrame([(*r, 1, 1, "y", 2) for r in rows], "doc_id long, text string, source string, i int, x int, h string, pos int")
    for keep_first in (True, False):
        assert collected(lines.remove_boilerplate(df, keep_first=keep_first)) == brute(rows, 10, keep_first)


def test_many_boilerplate_lines_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lines.if_small, "__defaults__", (3,))
    rows = [(k, "\n".join(f"shared {n}" for n in range(20)) + f"\nown {k}", f"s{k}") for k in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert collected(lines.remove_boilerplate(df)) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "shared\na", f"s{k}") for k in range(10)] + [(7, "shared\nb", "s1"), (7, "shared\nc", "s2")] + [(8, "shared\nd", "s1")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.remove_boilerplate(df)
    out = [r["text"] for r in found.collect()]
    assert len(out) == len(rows) and sum("shared" in t for t in out) >= 1 and sum("shared" not in t for t in out) >= 3


def test_empty_table(spark):
    assert lines.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_query_runs_no_python_on_executors(spark):
    plan = QUERIES["op9_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
