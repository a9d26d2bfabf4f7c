import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import simhash
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, components, docs_frame, documents, words


def brute_fp(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    at = list(range(len(fps)))
    links = [(a, b) for a in at for b in at[:a] if (fps[a][1] ^ fps[b][1]).bit_count() <= 3]
    group = components(at, links)
    low = {}
    for a in at:
        if fps[a][0] is not None:
            low[group[a]] = min(low.get(group[a], fps[a][0]), fps[a][0])
    return sorted(((i, f"{fp:016x}", low.get(group[a])) for a, (i, fp) in enumerate(fps)), key=repr)


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op6_simhash"](spark, SF).collect()), key=repr)
    assert got == brute(list(documents().items()))


EDGES = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "A b"), (5, "a B"), (6, "a b İ É"), (None, "a b"),
    (7, "x y z"), (7, "x y z"), (8, "x y z"), (9, "w " * 70_000 + "end"), (10, "\U0001f600 café 한"), (None, "alone here now"),
]


def test_edge_rows(spark):
    docs = docs_frame(spark, EDGES).withColumns({c: F.lit(1) for c in ("fp", "id", "n", "key", "component", "root")})
    found = simhash.near_duplicates(docs)
    got = sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in found.collect()), key=repr)
    assert got == brute(EDGES)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 4, 6, 7, 7, 9, 10, None, None], key=repr)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize("blocks,tile_rows", [(5, 8), (4, 16), (6, 1024)])
def test_links_of_any_tiling_equal_brute_force(spark, blocks, tile_rows):
    rng = random.Random(blocks)
    fps = set()
    for _ in range(12):  # dense groups, chains and strangers
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for _ in range(rng.choice([1, 1, 2, 4])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [tuple(r) for r in simhash.links(nodes, 3, blocks, tile_rows).collect()]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert components(fps, edges) == components(fps, near)


def test_keep_one_row_leaves_one_row_of_each_group(spark):
    docs = docs_frame(spark, EDGES).withColumns({c: F.lit(1) for c in ("fp", "id", "n", "key", "doc", "leads")})
    kept = simhash.keep_one_row(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 4, 6, 7, 9, 10, None], key=repr)
    copies = docs_frame(spark, [(None, "a b c")] * 40 + [(None, ""), (None, None), (3, " ")]).repartition(5)
    assert sorted(map(tuple, simhash.keep_one_row(copies).collect()), key=repr) == sorted([(None, "a b c"), (None, ""), (None, None), (3, " ")], key=repr)
    assert simhash.keep_one_row(docs_frame(spark, [])).collect() == []
