import hashlib
import math
import random

import numpy as np
import pytest

from sparkwright.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """The plain rounds: every part against every entry, Python integers."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in v], g)
            for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cuts = [(p * width, (p + 1) * width) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cuts]

    def nearest(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v[a:b], books[p])[0], []).append(v[a:b])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, sums = [], {}
    for i, v, g in kept:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        error = sum(d for _, d in found)
        sums[g] = sums.get(g, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, g))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[g], digest) for i, c, e, g in out), key=repr)


def run(spark, rows, schema=SCHEMA):
    found = vc.code_report(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def floats(rng, n):
    return [float(np.float32(rng.gauss(0, 0.2))) for _ in range(n)]


def test_equals_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, floats(rng, 8), rng.choice([None, 1, 2])) for i in range(700)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(80)]  # copies tie everywhere
    assert run(spark, rows) == brute(rows)


def test_active_entries_equal_a_full_scan():
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 6, (500, 3))
    book = rng.integers(-6, 6, (20, 3))  # small range: many ties
    entry, dist = vc.assign(x, book, np.ones(20, bool), np.full(500, -1), np.full(500, -1))
    for _ in range(30):
        moved = rng.random(20) < 0.2
        book = np.where(moved[:, None], rng.integers(-6, 6, (20, 3)), book)
        entry, dist = vc.assign(x, book, moved, entry, dist)
        d = ((x[:, None] - book) ** 2).sum(-1)
        assert (entry == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_stayed_parts_meet_moved_entries_only(monkeypatch):
    seen = []
    real = vc.distances
    monkeypatch.setattr(vc, "distances", lambda x, b: seen.append((len(x), len(b))) or real(x, b))
    x, book = np.arange(12).reshape(12, 1), np.arange(0, 12, 3).reshape(4, 1)
    entry, dist = vc.assign(x, book, np.ones(4, bool), np.full(12, -1), np.full(12, -1))
    seen.clear()
    moved = np.array([False, True, False, False])
    vc.assign(x, book + moved[:, None], moved, entry, dist)
    mine = int((entry == 1).sum())
    assert seen == [(mine, 4), (12 - mine, 1)]


def test_edge_rows(spark):
    rng = random.Random(6)
    rows = [(i, floats(rng, 8), 3) for i in range(40)]
    rows += [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [float("nan")] * 8, 1), (53, [float("inf")] * 8, 1),
             (None, floats(rng, 8), None), (None, floats(rng, 8), None), (7, floats(rng, 8), 9), (7, rows[7][1], 9)]
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS id", "2 AS entry", "3 AS dist", "4 AS vector", "5 AS error", "6 AS code", "7 AS sum_label")
    got = sorted((tuple(r) for r in vc.code_report(wide).collect()), key=repr)
    assert got == brute(rows)


def test_other_lengths_stay_without_code(spark):
    rng = random.Random(7)
    rows = [(i, floats(rng, 8), 1) for i in range(20)]
    got = run(spark, rows + [(90, [0.5] * 3, 1), (91, [], 2)])
    want = brute(rows)
    assert [r for r in got if r[0] < 90] == want
    digest = want[0][4]
    assert [r for r in got if r[0] >= 90] == [(90, None, None, want[0][3], digest), (91, None, None, None, digest)]


def test_huge_components_are_exact(spark):
    rng = random.Random(8)
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(i, [rng.gauss(0, 10.0**rng.randrange(0, 7)) for _ in range(4)], 1) for i in range(300)]
    assert run(spark, rows, schema) == brute(rows)
    rows += [(500, [1e300, -1e300, 2e9, 1.0], 2), (501, [3e300, 1e18, -5e17, 7.0], 2)]
    want = brute(rows)
    fits = lambda e: e if e < 1 << 63 else None
    got = run(spark, rows, schema)
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want]
    assert [r[2] for r in got] == [fits(r[2]) for r in want]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_empty(spark, rows):
    found = vc.code_report(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found.collect() == []


def test_partitioning_changes_nothing(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, floats(rng, 16), i % 5) for i in range(600)], SCHEMA)
    a, b = (sorted(tuple(r) for r in vc.code_report(rows.repartition(n)).collect()) for n in (1, 7))
    assert a == b
