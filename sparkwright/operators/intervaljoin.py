"""Join of two large sides on overlapping intervals, without a nested loop.

Two intervals overlap exactly if one starts inside the other, so the join is two
point-in-interval joins that share no pair: left starts in right intervals, and
right starts strictly inside left ones. For each, starts are dealt to range bins
of about equal size (bounds: approximate quantiles of all starts) and an interval
is cut into the fewest binary nodes over the bins that it covers (at most two per
level), so a wide interval is a few rows, not one per bin. A start meets the
nodes above its bin, on the levels that intervals use: an equi-join on the node. A
start's bin lies under exactly one node of an interval, so each pair is found
once; the exact comparison follows the join.

A node of few rows may hold most pairs, which no split by bytes sees. So rows are
counted per node and key first, and a node where one key has too many pairs
becomes a grid: starts are dealt to its rows and intervals to its columns by a
hash of the whole row, each meeting all cells of the other side. Tasks grow in
number with the pairs.

Only bounds, used levels and the number of pairs reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

ROWS_PER_BIN = 50_000
MAX_BINS = 1 << 14
CELL = 1 << 7
PAIRS_PER_TASK = 20_000_000
MAX_TASKS = 1 << 14


def _number(df: DataFrame, column: str) -> Column:
    """The value as a double that never falls where the value rises."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(c)).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"cannot bin {column} of type {kind.simpleString()}")


def _bounds(sides: list[tuple[DataFrame, str]], rows_per_bin: int) -> list[float]:
    """2^k - 1 rising bounds (padded with infinity) for 2^k bins of the starts."""
    starts = None
    for df, start in sides:
        mine = df.select(_number(df, start).alias("x"))
        starts = mine if starts is None else starts.unionByName(mine)
    n = starts.count()
    bins = 1
    while bins < MAX_BINS and bins * rows_per_bin < n:
        bins *= 2
    if bins == 1:
        return []
    cuts = starts.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 20 * bins)).first()[0]
    cuts = sorted(set(cuts))
    size = 1
    while size - 1 < len(cuts):
        size *= 2
    return cuts + [float("inf")] * (size - 1 - len(cuts))


def _halved(value: Column, table: Column, size: int) -> Column:
    """How many of the ``size`` (2^k - 1) rising numbers of a table lie below the value."""
    steps = F.array(*[F.lit((size + 1) >> k) for k in range(1, (size + 1).bit_length())])
    # the value is bound once, not worked out anew in each step
    return F.transform(
        F.array(value),
        lambda v: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) < v, at + s).otherwise(at)),
    ).getItem(0)


def _bin(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie below the value, by halving."""
    if not bounds:
        return F.lit(0)
    # one literal: an array would cost a driver call for each
    text = ",".join("Infinity" if b == float("inf") else repr(b) for b in bounds)
    return _halved(value, F.split(F.lit(text), ",").cast("array<double>"), len(bounds))


def _binned(df: DataFrame, column: str, bounds: list[float], name: str) -> DataFrame:
    """``df`` with the bin of a column's value as ``name``.

    A literal stands many times in each text of a plan, and the driver keeps the
    texts of all plans. So only every ``CELL``-th of many bounds is one; those between
    come from a small table."""
    value = _number(df, column)
    if len(bounds) < CELL:
        return df.withColumn(name, _bin(value, bounds))
    between = [(i // CELL, bounds[i : i + CELL - 1]) for i in range(0, len(bounds), CELL)]
    cells = df.sparkSession.createDataFrame(between, "__cell int, __between array<double>")
    # a left join: an inner one would work out the cell once more, to see that it is not null
    out = df.join(F.broadcast(cells), _bin(value, bounds[CELL - 1 :: CELL]) == F.col("__cell"), "left")
    within = _halved(value, F.col("__between"), CELL - 1)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__cell") * CELL + within).alias(name))


def _slots(first: Column, last: Column, levels: int) -> Column:
    """The fewest (level, node) that cover the bins first..last: on each level the
    lowest if it is a right child, the highest if it is a left child; the top
    level has every node left to cover. Null where a level has none."""
    out = []
    for level in range(levels):
        low, high = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(last + 1, level) - 1

        def node(x: Column, there: Column, level: int = level) -> Column:
            return F.when(there, F.struct(F.lit(level).alias("level"), x.alias("node")))

        if level < levels - 1:
            out += [node(low, (low <= high) & (low % 2 == 1)), node(high, (low <= high) & (high % 2 == 0))]
        else:
            out.append(node(low, low <= high))
    return F.array(*out)


def _nodes(first: Column, last: Column, levels: int) -> Column:
    return F.filter(_slots(first, last, levels), lambda x: x.isNotNull())


def _row_hash(df: DataFrame) -> Column:
    """The same for a row in every run; map and variant columns cannot be hashed."""
    names = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names])


def _counts(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    return df.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).cast("double").alias(n))


def _spread(
    dealt: DataFrame, cut: DataFrame, points: DataFrame, counted: DataFrame, lk: list[str], rk: list[str], by: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a grid cell (``__lp``, ``__li`` and ``__rp``, ``__ri``) and,
    if there are many pairs, in tasks by node and cell. ``points``, ``counted``:
    rows of ``dealt`` and ``cut`` by their keys; the first ``by`` keys are a node."""
    spark, names = dealt.sparkSession, [f"__k{i}" for i in range(len(lk))]
    both = points.join(counted, names)
    both = both.withColumn("__w", F.col("__np") * F.col("__ni")).checkpoint()
    total, most = both.agg(F.sum("__w"), F.max("__w")).first()
    total, most = total or 0.0, most or 0.0
    zero = F.lit(0).cast("long")
    if most <= PAIRS_PER_TASK:
        dealt = dealt.withColumn("__lp", zero).withColumn("__li", zero)
        cut = cut.withColumn("__rp", zero).withColumn("__ri", zero)
    else:
        # by node only, after its heaviest key: keys of two types may be equal without being one to one
        top = F.max_by(F.struct("__np", "__ni", "__w"), "__w")
        hot = both.where(F.col("__w") > PAIRS_PER_TASK).groupBy(*names[:by]).agg(top.alias("t")).select(*names[:by], "t.*")
        cells = F.ceil(F.col("__w") / PAIRS_PER_TASK)
        rows = F.least(F.greatest(F.round(F.sqrt(cells * F.col("__np") / F.col("__ni"))), F.lit(1.0)), F.least(cells, F.col("__np")))
        hot = hot.withColumn("__gp", rows.cast("long"))
        hot = hot.withColumn("__gi", F.ceil(cells / F.col("__gp"))).drop("__np", "__ni", "__w")

        def grid(df: DataFrame, keys: list[str], own: str, own_size: str, other: str, other_size: str) -> DataFrame:
            same = [F.col(k) == F.col(n) for k, n in zip(keys, names[:by])]
            out = df.withColumn("__h", _row_hash(df)).join(hot, same, "left")
            size, others = (F.coalesce(F.col(c), F.lit(1)) for c in (own_size, other_size))
            out = out.withColumn(own, F.pmod(F.col("__h"), size)).withColumn(other, F.explode(F.sequence(zero, others - 1)))
            return out.drop("__h", "__gp", "__gi", *names[:by])

        dealt, cut = grid(dealt, lk, "__lp", "__gp", "__li", "__gi"), grid(cut, rk, "__ri", "__gi", "__rp", "__gp")
    if total > PAIRS_PER_TASK:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * total / PAIRS_PER_TASK))
        tasks = min(tasks, MAX_TASKS)
        dealt = dealt.repartition(tasks, *[F.col(f"`{c}`") for c in [*lk, "__lp", "__li"]])
        cut = cut.repartition(tasks, *[F.col(f"`{c}`") for c in [*rk, "__rp", "__ri"]])
    return dealt, cut


def _starts_inside(
    points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, on: list[tuple[str, str]],
    bounds: list[float], strict_start: bool, open_end: bool,
) -> DataFrame:
    """Pairs of a point row and an interval row with the point inside."""
    levels = (len(bounds) + 1).bit_length()
    cut = _binned(_binned(intervals, start, bounds, "__first"), end, bounds, "__last")
    # the slots are a column of their own, as compiled code makes them
    cut = cut.withColumn("__n", _slots(F.col("__first"), F.col("__last"), levels)).drop("__first", "__last")
    cut = cut.withColumn("__n", F.explode("__n")).where(F.col("__n").isNotNull())
    cut = cut.select(*[F.col(f"`{c}`") for c in intervals.columns], F.col("__n.level").alias("__rl"), F.col("__n.node").alias("__rn"))
    lk, rk = ["__ll", "__ln", *[a for a, _ in on]], ["__rl", "__rn", *[b for _, b in on]]
    ensure_checkpoint_dir(cut.sparkSession)
    counted = _counts(cut, rk, "__ni").checkpoint()
    if levels == 1:
        dealt = points.withColumn("__ll", F.lit(0)).withColumn("__ln", F.lit(0))
    else:
        used = sorted(r[0] for r in counted.select("__k0").distinct().collect())
        dealt = _binned(points, point, bounds, "__b")
        dealt = dealt.withColumn("__ll", F.explode(F.array(*[F.lit(u) for u in used] or [F.lit(0)])))
        dealt = dealt.withColumn("__ln", F.expr("shiftright(__b, __ll)")).drop("__b")
    p, s, e = F.col(f"`{point}`"), F.col(f"`{start}`"), F.col(f"`{end}`")
    inside = (p > s if strict_start else p >= s) & (p < e if open_end else p <= e)
    dealt, cut = _spread(dealt, cut, _counts(dealt, lk, "__np"), counted, lk, rk)
    same = F.lit(True)
    for a, b in zip([*lk, "__lp", "__li"], [*rk, "__rp", "__ri"]):
        same = same & (F.col(f"`{a}`") == F.col(f"`{b}`"))
    return dealt.join(cut, same & inside).drop("__ll", "__ln", "__lp", "__li", "__rl", "__rn", "__rp", "__ri")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    on: list[tuple[str, str]] | None = None,
    closed: bool = True,
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Inner join of all rows whose intervals (start column, end column) overlap
    and whose ``on`` columns (left, right) are equal.

    ``closed``: ends belong to the interval, so touching ones and points match;
    otherwise the end does not and an empty interval matches nothing. A null
    bound or key and an end before its start match nothing. The sides may not
    share column names; both bounds of the two intervals have one type each that
    compares with the other side's. Repeated rows each match."""
    on = list(on or [])
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    (ls, le), (rs, re_) = left_interval, right_interval

    def proper(df: DataFrame, start: str, end: str) -> DataFrame:
        a, b = F.col(f"`{start}`"), F.col(f"`{end}`")
        return df.where(a <= b if closed else a < b)

    left, right = proper(left, ls, le), proper(right, rs, re_)
    bounds = _bounds([(left, ls), (right, rs)], rows_per_bin)
    names = [F.col(f"`{c}`") for c in left.columns + right.columns]
    a = _starts_inside(left, ls, right, rs, re_, on, bounds, False, not closed)
    b = _starts_inside(right, rs, left, ls, le, [(y, x) for x, y in on], bounds, True, not closed)
    return a.select(*names).unionByName(b.select(*names))
