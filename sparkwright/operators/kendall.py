"""Kendall tau-b (P02 ``method="kendall"``), exact, without emitting pairs.

1. Rows become weighted distinct points ``(x, y, w)`` (an aggregate, so a
   value held by a third of the rows collapses map-side).
2. Tie terms (pairs tied in x, in y, in both) are plain aggregates.
3. The concordant count ``#{x_p < x_q and y_p < y_q}`` is split by range
   blocks of x and y into four disjoint cases:

   * different x-block and different y-block: per-cell weights on a bounded
     block grid and a 2D prefix sum;
   * same y-block, lower x-block: a dominance count per y-block on (x-block, y);
   * same x-block, lower y-block: a dominance count per x-block on (x, y-block);
   * same cell: a dominance count per cell on (x, y).

   Each dominance count runs in one task per group (``applyInPandas``) with a
   vectorised merge count in numpy, O(m log^2 m) for m points, never pairs.
   Points that agree in both coordinates of a case are one weighted point, and
   a quantile bound is a block of its own, so a frequent value does not fill a
   group; a group of more than ``points_per_task`` points is blocked again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

MAX_BLOCKS = 512


def dominance_count(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> int:
    """Weighted count of point pairs with ``a_p < a_q`` and ``b_p < b_q``."""
    m = len(a)
    if m < 2:
        return 0
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order].astype(np.int64)
    _, rb = np.unique(b, return_inverse=True)
    rb = rb.astype(np.int64)
    big = int(w.sum()) ** 2 >= 2**62
    if big:
        w = w.astype(object)
    k = int(rb.max()) + 2
    vals, ws = rb.copy(), w.copy()
    idx = np.arange(m)
    total = 0
    s = 1
    while s < m:
        pair = idx // (2 * s)
        right = (idx // s) % 2 == 1
        gkey = pair * k + vals
        li, ri = np.nonzero(~right)[0], np.nonzero(right)[0]
        if len(ri):
            left_keys = gkey[li]
            cw = np.concatenate([np.zeros(1, dtype=ws.dtype), np.cumsum(ws[li])])
            hi = np.searchsorted(left_keys, gkey[ri], side="left")
            lo = np.searchsorted(left_keys, pair[ri] * k, side="left")
            total += int(np.sum(ws[ri] * (cw[hi] - cw[lo])))
        perm = np.argsort(gkey, kind="stable")
        vals, ws = vals[perm], ws[perm]
        s *= 2
    # pairs tied in a were counted when their b differs: remove them
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_ab = new_a | np.concatenate([[True], rb[1:] != rb[:-1]])
    of_a, of_ab = np.add.reduceat(w, np.flatnonzero(new_a)), np.add.reduceat(w, np.flatnonzero(new_ab))
    return total - (int(np.sum(of_a * of_a)) - int(np.sum(of_ab * of_ab))) // 2


def _pair_points(df: DataFrame, x: str, y: str) -> DataFrame:
    xc, yc = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    d = df.select(xc.alias("x"), yc.alias("y")).where(
        xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc) & ~F.isnan(yc)
    )
    return d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))


def _bucket(df: DataFrame, col: str, out: str, nb: int) -> DataFrame:
    """Block number of ``col``: between approximate quantiles, each bound being
    a block of its own, so that a frequent value stands alone."""
    bounds = df.select(F.percentile_approx(col, [i / nb for i in range(1, nb)], 10000).alias("b")).first()["b"]
    table = F.array(*[F.lit(float(v)) for v in sorted(set(bounds))])
    below = F.size(F.filter(table, lambda v: v < F.col(col)))
    return df.withColumn(out, (2 * below + F.array_contains(table, F.col(col)).cast("int")).cast("double"))


def _grouped_dominance(points: DataFrame, keys: list[str], a: str, b: str, limit: int) -> int:
    """Sum of dominance counts of (a, b) inside each group of ``keys``.

    Points that agree in (a, b) become one with their weight first, so a block
    that holds a frequent value shrinks to its distinct points. A group that is
    still over ``limit`` is a problem of the same kind and is blocked itself;
    there are at most points / limit of those."""
    keys = keys or ["__one"]
    if keys == ["__one"]:
        points = points.withColumn("__one", F.lit(0))
    points = points.groupBy(*keys, F.col(a).alias("pa"), F.col(b).alias("pb")).agg(F.sum("w").alias("w"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    large = [r.asDict() for r in sizes.where(F.col("m") > limit).collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = dominance_count(pdf["pa"].to_numpy(), pdf["pb"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"c": [str(c)]})

    ship_package(points.sparkSession)
    fits = points
    if large:
        table = points.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], points.select(*keys).schema)
        fits = points.join(F.broadcast(table), keys, "left_anti")
    total = sum(int(r.c) for r in fits.groupBy(*keys).applyInPandas(run, "c string").collect())
    for r in large:
        one = F.lit(True)
        for k in keys:
            one = one & (F.col(k) == F.lit(r[k]))
        inner = points.where(one).select(F.col("pa").cast("double").alias("x"), F.col("pb").cast("double").alias("y"), "w")
        total += _blocked_concordant(inner, r["m"], limit)
    return total


def _blocked_concordant(pts: DataFrame, m: int, points_per_task: int) -> int:
    """Concordant count of one set of weighted points through the four block
    cases. The grid has at most MAX_BLOCKS ** 2 cells, whatever m is; blocks
    that stay large are blocked again."""
    nb = max(2, min(MAX_BLOCKS, math.ceil(m / points_per_task) * 2))
    ensure_checkpoint_dir(pts.sparkSession)
    blk = _bucket(_bucket(pts, "x", "bx", nb), "y", "by", nb).checkpoint(eager=True)
    cells = blk.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect()
    width = 2 * nb + 1  # a bound that is frequent is a block of its own
    grid = np.zeros((width + 1, width + 1), dtype=object)
    for r in cells:
        grid[int(r.bx), int(r.by)] += int(r.w)
    pre = grid.cumsum(axis=0).cumsum(axis=1)  # inclusive 2D prefix
    case_a = 0
    for r in cells:
        i, j = int(r.bx), int(r.by)
        if i and j:
            case_a += int(r.w) * int(pre[i - 1, j - 1])
    case_b = _grouped_dominance(blk, ["by"], "bx", "y", points_per_task)
    case_c = _grouped_dominance(blk, ["bx"], "x", "by", points_per_task)
    case_d = _grouped_dominance(blk, ["bx", "by"], "x", "y", points_per_task)
    return case_a + case_b + case_c + case_d


def kendall_tau(df: DataFrame, x: str, y: str, points_per_task: int = 500_000) -> float | None:
    """Exact tau-b of two numeric columns (pairwise complete), as pandas / scipy."""
    pts = _pair_points(df, x, y)
    ties = pts.agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("n3")).first()
    n, m = int(ties["n"] or 0), int(ties["m"] or 0)
    if n < 2:
        return None
    n1 = pts.groupBy("x").agg(F.sum("w").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
    n2 = pts.groupBy("y").agg(F.sum("w").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
    n0 = n * (n - 1) // 2
    n1, n2, n3 = int(n1), int(n2), int(ties["n3"])
    if m <= points_per_task:
        nc = _grouped_dominance(pts, [], "x", "y", points_per_task)
    else:
        nc = _blocked_concordant(pts, m, points_per_task)
    untied = n0 - n1 - n2 + n3
    s = 2 * nc - untied
    denom = math.sqrt((n0 - n1) * (n0 - n2))
    return s / denom if denom else None


def kendall_long(df: DataFrame, columns: list[str], points_per_task: int = 500_000) -> DataFrame:
    """Long form (col1, col2, corr) of Kendall tau-b for all column pairs.

    All pairs share the jobs: one long table of weighted points keyed by pair,
    one job for every tie term, one grouped task per small pair; pairs with
    more than ``points_per_task`` distinct points take the blocked path."""
    spark = df.sparkSession
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    vals: dict[tuple, float | None] = {}
    if pairs:
        parts = []
        for k, (a, b) in enumerate(pairs):
            xa, yb = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
            parts.append(F.struct(F.lit(k).alias("k"), xa.alias("x"), yb.alias("y")))
        long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.k", "p.x", "p.y")
        long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
        pts = long.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("w"))
        half = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
        t = pts.groupBy("k").agg(
            F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), half("w").alias("n3"), F.lit(0.0).alias("n1"), F.lit(0.0).alias("n2")
        )
        tx = pts.groupBy("k", "x").agg(F.sum("w").alias("c")).groupBy("k").agg(half("c").alias("n1"))
        ty = pts.groupBy("k", "y").agg(F.sum("w").alias("c")).groupBy("k").agg(half("c").alias("n2"))
        stats = {r.k: r for r in t.drop("n1", "n2").join(tx, "k").join(ty, "k").collect()}
        small = [k for k, r in stats.items() if r.m <= points_per_task]
        nc: dict[int, int] = {}
        if small:
            ship_package(spark)

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                c = dominance_count(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
                return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "c": [str(c)]})

            for r in pts.where(F.col("k").isin(small)).groupBy("k").applyInPandas(run, "k int, c string").collect():
                nc[r.k] = int(r.c)
        for k, (a, b) in enumerate(pairs):
            r = stats.get(k)
            if r is None or r.n < 2:
                vals[(a, b)] = None
                continue
            if k not in nc:
                nc[k] = _blocked_concordant(_pair_points(df, a, b), r.m, points_per_task)
            n0 = r.n * (r.n - 1) // 2
            n1, n2, n3 = int(r.n1), int(r.n2), int(r.n3)
            s_ = 2 * nc[k] - (n0 - n1 - n2 + n3)
            denom = math.sqrt((n0 - n1) * (n0 - n2))
            vals[(a, b)] = s_ / denom if denom else None
    rows = [(a, b, 1.0 if a == b else vals.get((a, b), vals.get((b, a)))) for a in columns for b in columns]
    return spark.createDataFrame(rows, "col1 string, col2 string, corr double")
