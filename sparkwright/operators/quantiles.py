"""Exact quantiles (linear interpolation, as pandas / DuckDB quantile_cont) at scale.

Spark's ``percentile`` aggregate keeps a value->count map of the whole group
in one task; on a 100 TB column that is unbounded. Here

* a series of at most ``collect_limit`` values is solved on the executors in
  one aggregate (a sorted list of bounded length), and stays a DataFrame;
* a larger one -- there are at most ``rows / collect_limit`` of them -- is
  refined: each pass counts the values inside a target's interval in
  ``buckets`` bins (partial aggregation, at most targets x buckets rows), the
  bin of the wanted rank becomes the next interval, until it holds
  ``collect_limit`` values at most. -Infinity and Infinity are counted apart.

The answer is the same whichever way a series goes. Interpolating between
infinities of different sign gives null.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = "__series"


def _long_values(df: DataFrame, columns: list[str], group_by: list[str]) -> DataFrame:
    """(group..., __series, __x) with one row per non-null value."""
    parts = [F.struct(F.lit(c).alias("s"), F.col(c).cast("double").alias("x")) for c in columns]
    out = df.select(*[F.col(g) for g in group_by], F.explode(F.array(*parts)).alias("__p"))
    out = out.select(*group_by, F.col("__p.s").alias(_KEY), F.col("__p.x").alias("__x"))
    return out.where(F.col("__x").isNotNull() & ~F.isnan("__x"))


def _interp(lo: float, hi: float, frac: float) -> float | None:
    if frac == 0 or lo == hi:
        return lo
    x = lo + (hi - lo) * frac
    return None if math.isnan(x) else x


def _picked(xs: Column, p: float) -> Column:
    """Quantile ``p`` of a sorted, non-empty list."""
    pos = F.lit(p) * (F.size(xs) - 1)
    lo, hi = F.element_at(xs, (F.floor(pos) + 1).cast("int")), F.element_at(xs, (F.ceil(pos) + 1).cast("int"))
    frac = pos - F.floor(pos)
    x = F.when((frac == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * frac)
    return F.when(~F.isnan(x), x)


def grouped_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    group_by: list[str],
    buckets: int = 2048,
    collect_limit: int = 200000,
) -> DataFrame:
    """(group..., ``__series`` = column name, ``q`` = array of quantiles), one row
    per group and column with a value. Nothing about a small group leaves the
    executors; a null group is a group."""
    vals = _long_values(df, columns, group_by)
    keys = [*group_by, _KEY]
    counts = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = [tuple(r[k] for k in keys) for r in counts.where(F.col("n") > collect_limit).collect()]
    schema = T.StructType([f for f in vals.schema.fields if f.name in keys])
    schema = T.StructType([schema[k] for k in keys])
    rest, refined = vals, None
    if large:
        table = df.sparkSession.createDataFrame(large, schema)
        same = [vals[k].eqNullSafe(table[k]) for k in keys]
        rest = vals.join(F.broadcast(table), same, "left_anti")  # at most rows / collect_limit series
        only = vals.join(F.broadcast(table), same, "left_semi")
        found = _refine(only, keys, probs, buckets, collect_limit, None)
        rows = [(*k, v) for k, v in found.items()]
        refined = df.sparkSession.createDataFrame(rows, T.StructType([*schema.fields, T.StructField("q", T.ArrayType(T.DoubleType()))]))
    xs = rest.groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("xs"))
    out = xs.select(*keys, F.array(*[_picked(F.col("xs"), p) for p in probs]).alias("q"))
    return out if refined is None else out.unionByName(refined)


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    group_by: list[str] | None = None,
    buckets: int = 2048,
    collect_limit: int = 200000,
    stats: dict[tuple, tuple] | None = None,
) -> dict[tuple, list[float | None]]:
    """``{(group values..., column): [q(p) for p in probs]}`` on the driver, for
    a number of series that is known to be small (the columns of a table, the
    groups of a chart); :func:`grouped_quantiles` for any number. A column
    without a value maps to Nones."""
    group_by = list(group_by or [])
    if not columns:
        return {}
    keys = group_by + [_KEY]
    result = _refine(_long_values(df, columns, group_by), keys, probs, buckets, collect_limit, stats)
    if not group_by:
        for c in columns:
            result.setdefault((c,), [None] * len(probs))
    return result


_INF = float("inf")


def _refine(vals, keys, probs, buckets, collect_limit, stats) -> dict[tuple, list[float | None]]:
    spark = vals.sparkSession
    finite = F.abs("__x") < _INF
    if stats is not None and all(abs(v[i]) < _INF for v in stats.values() if v[0] for i in (1, 2)):
        base = [dict(zip(keys + ["n", "mn", "mx"], (*k, *v)), low=0, high=0) for k, v in stats.items() if v[0]]
    else:
        base = [
            r.asDict()
            for r in vals.groupBy(*keys)
            .agg(
                F.count("__x").alias("n"), F.min(F.when(finite, F.col("__x"))).alias("mn"), F.max(F.when(finite, F.col("__x"))).alias("mx"),
                F.count_if(F.col("__x") == -_INF).alias("low"), F.count_if(F.col("__x") == _INF).alias("high"),
            )
            .collect()
        ]
    result: dict[tuple, list[float | None]] = {}
    state: dict[tuple, list] = {}  # (series, rank) -> [a, b, rows below a]
    found: dict[tuple, float] = {}
    wanted, inside = {}, {}
    for row in base:
        skey, n = tuple(row[k] for k in keys), row["n"]
        inside[skey] = n - row["low"] - row["high"]
        plan = []
        for p in probs:
            pos = p * (n - 1)
            rf, rc = int(math.floor(pos)), min(int(math.ceil(pos)), n - 1)
            plan.append((rf, rc, pos - rf))
            for r in (rf, rc):
                if r < row["low"]:
                    found[(skey, r)] = -_INF
                elif r >= n - row["high"]:
                    found[(skey, r)] = _INF
                elif row["mn"] == row["mx"]:
                    found[(skey, r)] = row["mn"]
                else:
                    state[(skey, r)] = [row["mn"], row["mx"], row["low"]]
        wanted[skey] = plan
    vals = vals.where(finite)

    iv_schema = T.StructType(
        [vals.schema[k] for k in keys]
        + [T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType()), T.StructField("__iv", T.LongType())]
    )
    small = [(t, (t[0], *state[t][:2])) for t in state if inside[t[0]] <= collect_limit]
    if small:  # few enough values to skip the histogram passes
        _pick_ranks(spark, vals, keys, iv_schema, state, small, found)
    while state:
        ivs: dict[tuple, int] = {}
        for (skey, _), (a, b, _) in state.items():
            ivs.setdefault((skey, a, b), len(ivs))
        joined = _inside(spark, vals, keys, iv_schema, ivs)
        # halves, so that the span of the largest doubles does not overflow
        x, a, b = F.col("__x") / 2, F.col("__a") / 2, F.col("__b") / 2
        width = b / float(buckets) - a / float(buckets)
        near = F.when(F.col("__x") == F.col("__a"), F.lit(0)).when(F.col("__x") == F.col("__b"), F.lit(buckets - 1)).otherwise(F.lit(1))
        even = F.least(F.lit(buckets - 1).cast("long"), F.floor((x - a) / width).cast("long"))
        hist = (
            joined.groupBy("__iv", F.when(width > 0, even).otherwise(near).alias("__k"))
            .agg(F.count("*").alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
            .collect()
        )
        by_iv = defaultdict(list)
        for h in hist:
            by_iv[h["__iv"]].append((h["__k"], h["c"], h["lo"], h["hi"]))
        for v in by_iv.values():
            v.sort()
        picked = []
        for (skey, r), (a_, b_, below) in list(state.items()):
            cum = below
            for _, c, lo, hi in by_iv[ivs[(skey, a_, b_)]]:
                if r < cum + c:
                    if lo == hi:
                        found[(skey, r)] = lo
                        del state[(skey, r)]
                    else:
                        state[(skey, r)] = [lo, hi, cum]
                        if c <= collect_limit:
                            picked.append(((skey, r), (skey, lo, hi)))
                    break
                cum += c
            else:  # pragma: no cover - rank beyond data means bad counts
                raise RuntimeError("quantile refinement lost its rank")
        if picked:
            _pick_ranks(spark, vals, keys, iv_schema, state, picked, found)

    for skey, plan in wanted.items():
        result[skey] = [_interp(found[(skey, rf)], found[(skey, rc)], frac) for rf, rc, frac in plan]
    return result


def _inside(spark, vals, keys, iv_schema, ivs) -> DataFrame:
    """Values within the intervals ``ivs`` ((series, a, b) -> number) of their
    series; a null group is a group. The table has a row per open interval."""
    table = spark.createDataFrame([(*k[0], k[1], k[2], i) for k, i in ivs.items()], iv_schema)
    table = table.select(*[F.col(k).alias("__i_" + k) for k in keys], "__a", "__b", "__iv")
    same = [vals[k].eqNullSafe(table["__i_" + k]) for k in keys]
    return vals.join(F.broadcast(table), same).where(F.col("__x").between(F.col("__a"), F.col("__b")))


def _pick_ranks(spark, vals, keys, iv_schema, state, targets, found) -> None:
    """Ranks of the targets whose interval holds few enough values: sorted in
    one bounded list per interval on the executors, which sends the ranks only."""
    ivs: dict[tuple, int] = {}
    ranks = defaultdict(list)
    for (skey, r), iv in targets:
        i = ivs.setdefault(iv, len(ivs))
        ranks[i].append(r - state[(skey, r)][2])
    asked = spark.createDataFrame([(i, rs) for i, rs in ranks.items()], "__iv long, rs array<long>")
    lists = _inside(spark, vals, keys, iv_schema, ivs).groupBy("__iv").agg(F.sort_array(F.collect_list("__x")).alias("xs"))
    got = lists.join(F.broadcast(asked), "__iv").select(
        "__iv", F.arrays_zip("rs", F.transform("rs", lambda r: F.element_at("xs", (r + 1).cast("int"))).alias("v")).alias("z")
    )
    values = {(g["__iv"], z["rs"]): z["v"] for g in got.collect() for z in g["z"]}
    for (skey, r), iv in targets:
        below = state.pop((skey, r))[2]
        found[(skey, r)] = values[(ivs[iv], r - below)]


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], **kw) -> dict[str, list[float | None]]:
    """Ungrouped convenience: ``{column: [q(p)...]}``."""
    res = exact_quantiles(df, columns, probs, **kw)
    return {k[-1]: v for k, v in res.items()}
