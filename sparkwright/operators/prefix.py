"""Order-dependent windows (running totals, lag / lead, rolling, forward fill)
without pulling a whole table -- or a whole hot group -- into one task.

``Window.orderBy(k)`` without a partition key sends every row to one task.
Instead rows are cut into *range buckets* along the groups and the whole order:

* one range shuffle sorts the rows, Spark's own comparison of the order columns
  deciding, so text, nulls, times and falling columns need no numeric form. A
  row's number in its sorted task gives its bucket of ``rows_per_bucket`` rows,
  and the numbered rows are checkpointed, so every later pass sees the same
  buckets. The number of passes does not depend on the number of buckets, and
  nothing but a row count reaches the driver;
* rows that agree in all their order columns share a bucket, also where the cut
  by numbers would part them;
* windows run partitioned by ``(group..., bucket)``; only rows that agree in
  all their order columns can keep a bucket over-full;
* a group lies in neighbouring buckets, most groups in one. Only the parts of a
  group beyond its first bucket get a *carry*: the aggregate of its earlier
  buckets, from a per-bucket ``groupBy`` and a window over bucket rows. There
  are fewer of those than buckets;
* look-back / look-ahead windows (lag, lead, rolling) are right inside a bucket
  except for its first / last ``k`` rows; those heads and tails (at most
  ``2k`` per bucket) of the groups in several buckets are re-evaluated in one
  small window ordered by ``(bucket, position)`` and patched back with a join.

A null group is a group like others, and NaN is missing, at every size.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import value_or_null
from ..session import ensure_checkpoint_dir

BUCKET = "__bkt"
POS = "__pos"
CNT = "__cnt"

DEFAULT_ROWS_PER_BUCKET = 2_000_000
#: Rows of a task of the sorting shuffle.
ROWS_PER_TASK = 250_000
#: Rows up to which the tables of carries and bucket edges are broadcast.
BROADCAST_ROWS = 300_000
ROW = "__row"
#: Bits of a row number that count within its task (monotonically_increasing_id).
TASK_BITS = 33


def _names(order_by) -> list:
    return list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]


def _order_cols(order_by) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in _names(order_by)]


def add_buckets(df: DataFrame, order_by, **kw) -> DataFrame:
    """Append ``__bkt``: the range bucket of the order tuple (a number that
    sorts as the rows do)."""
    return _bucketize(df, order_by, **kw)[0]


def _bucketize(
    df: DataFrame,
    order_by,
    rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
    n: int | None = None,
    group_by: list[str] | None = None,
    peers: list[str] | None = None,
) -> tuple[DataFrame, int]:
    """Append ``__bkt``, rising along (``group_by``, ``order_by``); also a bound
    of the number of buckets, 1 where the rows fit one. Rows that agree in
    ``peers`` (by default the groups and the order, if named) share a bucket.
    One count unless ``n`` is known, one range shuffle."""
    if n is None:
        n = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    per = max(1, int(rows_per_bucket))
    if n <= per:
        return df.withColumn(BUCKET, F.lit(0).cast("long")), 1
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    groups, names = list(group_by or []), _names(order_by)
    if peers is None and all(isinstance(o, str) for o in names):
        peers = [*groups, *names]
    order = [*[F.col(g) for g in groups], *_order_cols(order_by)]
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per)), -(-n // ROWS_PER_TASK))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = rows.withColumn(ROW, F.monotonically_increasing_id()).checkpoint(eager=True)
    at = F.col(ROW).bitwiseAND(F.lit((1 << TASK_BITS) - 1)) % per
    out = rows.withColumn(BUCKET, F.col(ROW) - at)
    if peers:
        # equal rows lie in one task; those that go on beyond a bucket are its last row
        edges = out.where((at == 0) | (at == per - 1))
        twins = [F.col(c).alias(f"__p{i}") for i, c in enumerate(peers)]
        spread = edges.groupBy(*twins).agg(F.min(BUCKET).alias("__to"), F.max(BUCKET).alias("__end"))
        spread = spread.where("__to < __end").drop("__end").checkpoint(eager=True)
        if not spread.isEmpty():
            same = F.lit(True)
            for i, c in enumerate(peers):
                same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
            out = out.join(F.broadcast(spread), same, "left").withColumn(BUCKET, F.coalesce("__to", BUCKET))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], BUCKET), n // per + 2 * tasks


def _spec(group_by: list[str], order_by) -> Window:
    return Window.partitionBy(*group_by, BUCKET).orderBy(*_order_cols(order_by))


def _same_group(group_by: list[str]) -> Column:
    """Equality of the group columns with their ``__g_`` twins, null with null."""
    same = F.lit(True)
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col("__g_" + g))
    return same


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, for a join with the row table."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, str]],
    order_by,
    group_by: list[str] | None = None,
    keep_null_rows: bool = True,
    cut: int | None = None,
    **bucket_kw,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` / ``count`` / ``last`` (last non-null).

    ``specs``: ``{out_name: (func, column)}``. With ``keep_null_rows`` the output
    is null where the input is null (pandas ``cumsum`` semantics) while the
    running value continues past it; ``last`` is a forward fill. ``cut``: ``df``
    has the buckets of these groups and this order already (their bound, see
    :func:`_bucketize`) and keeps them.
    """
    group_by = list(group_by or [])
    b, nb = (df, cut) if cut else _bucketize(df, order_by, group_by=group_by, **bucket_kw)
    single = nb == 1
    w = _spec(group_by, order_by).rowsBetween(Window.unboundedPreceding, 0)
    order_struct = F.struct(*_order_cols(order_by))

    carry_aggs, local = [], {}
    for name, (fn, col) in specs.items():
        c = value_or_null(df, col)
        if fn == "sum":
            local[name] = F.sum(c).over(w)
            carry_aggs.append(F.sum(c).alias(name))
        elif fn == "max":
            local[name] = F.max(c).over(w)
            carry_aggs.append(F.max(c).alias(name))
        elif fn == "min":
            local[name] = F.min(c).over(w)
            carry_aggs.append(F.min(c).alias(name))
        elif fn == "count":
            local[name] = F.count(c).over(w)
            carry_aggs.append(F.count(c).alias(name))
        elif fn == "last":
            local[name] = F.last(c, ignorenulls=True).over(w)
            carry_aggs.append(F.max_by(c, F.when(c.isNotNull(), order_struct)).alias(name))
        else:
            raise ValueError(f"unknown running function {fn!r}")

    if single:  # one bucket: the local window is the whole answer
        final = []
        for name, (fn, col) in specs.items():
            v = local[name]
            if keep_null_rows and fn != "last":
                v = F.when(value_or_null(df, col).isNotNull(), v)
            final.append(v.alias(name))
        return b.select(*[F.col(c) for c in df.columns if c not in specs], *final)

    per_bucket = b.groupBy(*group_by, BUCKET).agg(*carry_aggs)
    along = Window.partitionBy(*group_by).orderBy(BUCKET)
    wc = along.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, (fn, _) in specs.items():
        src = F.col(name)
        if fn in ("sum", "count"):
            e = F.sum(src).over(wc)
        elif fn == "max":
            e = F.max(src).over(wc)
        elif fn == "min":
            e = F.min(src).over(wc)
        else:
            e = F.last(src, ignorenulls=True).over(wc)
        carry_cols.append(e.alias("__c_" + name))
    carry = per_bucket.select(
        *[F.col(g).alias("__g_" + g) for g in group_by], F.col(BUCKET).alias("__cb"), *carry_cols, F.row_number().over(along).alias("__k")
    )
    carry = _small(carry.where("__k > 1").drop("__k"), nb)  # the first part of a group has none

    out = b.select("*", *[v.alias("__l_" + k) for k, v in local.items()])
    out = out.join(carry, _same_group(group_by) & (F.col(BUCKET) == F.col("__cb")), "left")
    final = []
    for name, (fn, col) in specs.items():
        l, c = F.col("__l_" + name), F.col("__c_" + name)
        if fn in ("sum", "count"):
            v = F.when(l.isNull() & c.isNull(), F.lit(None)).otherwise(F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0)))
            if fn == "count":
                v = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif fn == "max":
            v = F.greatest(l, c)
        elif fn == "min":
            v = F.least(l, c)
        else:
            v = F.coalesce(l, c)
        if keep_null_rows and fn != "last":
            v = F.when(value_or_null(df, col).isNotNull(), v)
        final.append(v.alias(name))
    return out.select(*[F.col(c) for c in df.columns if c not in specs], *final)


def sliding(
    df: DataFrame,
    builder: Callable[[Window], dict[str, Column]],
    order_by,
    group_by: list[str] | None = None,
    back: int = 0,
    ahead: int = 0,
    cut: int | None = None,
    **bucket_kw,
) -> DataFrame:
    """Window expressions that look at most ``back`` rows behind / ``ahead`` rows ahead.

    ``builder(w)`` returns ``{name: expression over w}`` where ``w`` is a
    partitioned, ordered window (add frames with ``w.rowsBetween``). It is
    evaluated once per bucket and once over the heads / tails table. ``cut``: as
    for :func:`running`.
    """
    group_by = list(group_by or [])
    b, nb = (df, cut) if cut else _bucketize(df, order_by, group_by=group_by, **bucket_kw)
    w = _spec(group_by, order_by)
    if nb == 1:  # no bucket edges to patch
        exprs = builder(w)
        return b.select(*[c for c in df.columns if c not in exprs], *[e.alias(n) for n, e in exprs.items()])
    local = b.withColumn(POS, F.row_number().over(w)).withColumn(
        CNT, F.count(F.lit(1)).over(Window.partitionBy(*group_by, BUCKET))
    )
    exprs = builder(w)
    names = list(exprs)
    local = local.select("*", *[e.alias(n) for n, e in exprs.items()])
    # heads / tails of every bucket: a head row's look-back rows are earlier
    # heads of its own bucket or tails of earlier buckets (and vice versa); where
    # a window looks both ways, a head row's look-ahead rows have to be there too
    k = back + ahead
    edge = (F.col(POS) <= F.lit(k)) | (F.col(CNT) - F.col(POS) < F.lit(k))
    small = local.where(edge).drop(*names)
    if group_by:  # a group in one bucket has no edge to patch
        spread = b.groupBy(*[F.col(g).alias("__g_" + g) for g in group_by]).agg(F.min(BUCKET).alias("__from"), F.max(BUCKET).alias("__to"))
        small = small.join(_small(spread.where("__from < __to"), nb), _same_group(group_by), "left_semi")
    ws = Window.partitionBy(*group_by).orderBy(BUCKET, POS)
    fix = small.select(
        *[F.col(g).alias("__g_" + g) for g in group_by], F.col(BUCKET).alias("__cb"), F.col(POS).alias("__cp"),
        *[e.alias("__f_" + n) for n, e in builder(ws).items()],
    )
    here = (F.col(BUCKET) == F.col("__cb")) & (F.col(POS) == F.col("__cp"))
    out = local.join(_small(fix, 2 * k * nb), _same_group(group_by) & here, "left")
    at_edge = (F.col(POS) <= F.lit(back)) | (F.col(CNT) - F.col(POS) < F.lit(ahead))
    patched = [F.when(F.col("__cb").isNotNull() & at_edge, F.col("__f_" + n)).otherwise(F.col(n)).alias(n) for n in names]
    keep = [c for c in df.columns if c not in names]
    return out.select(*keep, *patched)


def lag(df: DataFrame, column: str, periods: int, order_by, group_by=None, name=None, **kw) -> DataFrame:
    """pandas ``shift(periods)``: positive looks back, negative looks ahead."""
    name = name or f"{column}_lag_{periods}"

    def build(w):
        return {name: F.lag(value_or_null(df, column), periods).over(w)}

    return sliding(df, build, order_by, group_by, back=max(periods, 0), ahead=max(-periods, 0), **kw)


def rolling_mean(
    df: DataFrame, column: str, window: int, order_by, group_by=None, name=None, min_periods=None, **kw
) -> DataFrame:
    """pandas ``rolling(window, min_periods).mean()`` (min_periods defaults to window)."""
    name = name or f"{column}_rolling_avg_{window}"
    need = window if min_periods is None else min_periods

    def build(w):
        fr, x = w.rowsBetween(-(window - 1), 0), value_or_null(df, column)
        return {name: F.when(F.count(x).over(fr) >= F.lit(need), F.avg(x).over(fr))}

    return sliding(df, build, order_by, group_by, back=window - 1, **kw)
