import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkwright.llm import embeddings
from sparkwright.llm.workloads import QUERIES

from .helpers import SF, components


def brute(rows):
    at = range(len(rows))

    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for a in at:
        for b in range(a):
            (_, x, k), (_, y, m) = rows[a], rows[b]
            if k == m and good(x, k) and good(y, m) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((a, b))
    group, n, low = components(at, links), [0] * len(rows), {}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for a in at:
        if rows[a][0] is not None:
            low[group[a]] = min(low.get(group[a], rows[a][0]), rows[a][0])
    out = [(rows[a][0], n[a], low.get(group[a])) for a in at]
    return sorted(((i, k, c, i is not None and i == c) for i, k, c in out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert collected(QUERIES["op10_embedding_dedup"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("tile_rows", [512, 8])
def test_edge_rows_and_tiles(spark, tile_rows):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    near = [[float(x) for x in base + rng.standard_normal(16) * 0.08] for _ in range(40)]
    rows = [(i, v, 0) for i, v in enumerate(near)]
    rows += [(50 + i, [float(x) for x in base], 0) for i in range(5)] + [(60, [float(x) for x in base], 1)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (70, None, 0), (71, [], 0), (72, [0.0] * 16, 0), (73, [nan] + near[0][1:], 0), (74, [inf] + near[0][1:], 0),
        (75, [None] + near[0][1:], 0), (76, near[0], None), (None, near[0], 0), (None, [1.0, 2.0], 3), (77, [1.0, 2.0], 0),
        (78, [2.0, 4.0], 0), (79, [1e300, 2e300], 0), (80, [1e-300, 2e-300], 0), (50, near[3], 0), (81, [-0.0, 1.0], 5), (82, [0.0, 1.0], 5),
    ]
    df = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, node long, root long, copies int"
    )
    assert collected(embeddings.near_duplicates(df, tile_rows=tile_rows)) == brute(rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 64))
    b = a * 0.7 + rng.standard_normal((300, 64))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    est, error = embeddings.estimate(a, b)
    off = est - a @ b.T
    assert abs(off.mean()) < 0.005
    assert (np.abs(off) <= embeddings.EPSILON * error).all()


def test_band_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
    met = (embeddings.band_codes(a) == embeddings.band_codes(b)).any(axis=1)
    assert met.mean() >= 0.999
