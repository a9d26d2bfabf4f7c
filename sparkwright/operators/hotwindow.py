"""Window functions for partitions of any size.

A plain window sorts a partition in one task. Here the keys with more rows than
``rows_per_bucket`` are found by a count (there are at most rows / rows_per_bucket
of them); the rows of all other keys take the plain window. A hot key's rows are
cut into range buckets of the order (:mod:`prefix`), evaluated per (key, bucket),
and completed by what earlier buckets carry: their row counts for positions and
ranks, their distinct order values for dense ranks, their sums, extremes and
first values for running frames. Rows that agree in the order share a bucket, so
a peer group is never cut. Frames over a few rows and lag / lead are patched at
the bucket edges. All functions of a call share the buckets. Nothing but the list
of hot keys reaches the driver; it is bounded by rows / rows_per_bucket.

Nulls order as in Spark (first when rising, last when falling) and are a
partition of their own as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from . import prefix
from .prefix import BUCKET

POSITION = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"}
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}
FRAMES = ("partition", "rows", "range")


class Fn:
    """A window function: ``kind``, its column and its frame or argument.

    kinds: row_number, rank, dense_rank, percent_rank, cume_dist, ntile(n);
    sum, avg, min, max, count over a ``frame``: "partition", "rows" or "range"
    (from the start to the current row or its peers), or (back, ahead) rows;
    first, last (of the partition); lag, lead (n rows)."""

    def __init__(self, kind: str, column: str | None = None, n: int = 1, frame: str | tuple[int, int] = "range"):
        known = POSITION | FOLDS.keys() | {"first", "last", "lag", "lead"}
        if kind not in known:
            raise ValueError(f"unknown window function {kind}; known: {', '.join(sorted(known))}")
        if kind not in POSITION and column is None:
            raise ValueError(f"{kind} needs a column")
        if not (frame in FRAMES or isinstance(frame, tuple) and len(frame) == 2 and min(frame) >= 0):
            raise ValueError("frame: partition, rows, range or (rows back, rows ahead)")
        if kind == "ntile" and n < 1:
            raise ValueError("ntile needs a positive number of tiles")
        self.kind, self.column, self.n, self.frame = kind, column, n, frame

    @property
    def moving(self) -> bool:
        return self.kind in ("lag", "lead") or self.kind in FOLDS and isinstance(self.frame, tuple)

    def reach(self) -> tuple[int, int]:
        if self.kind == "lag":
            return self.n, 0
        return (0, self.n) if self.kind == "lead" else self.frame

    def over(self, w, whole) -> Column:
        """The plain window expression; ``w`` is ordered, ``whole`` is not."""
        c = F.col(f"`{self.column}`") if self.column else None
        if self.kind == "ntile":
            return F.ntile(self.n).over(w)
        if self.kind in POSITION:
            return getattr(F, self.kind)().over(w)
        if self.kind in ("lag", "lead"):
            return getattr(F, self.kind)(c, self.n).over(w)
        if self.kind in ("first", "last"):
            return getattr(F, self.kind)(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if isinstance(self.frame, tuple):
            return FOLDS[self.kind](c).over(w.rowsBetween(-self.frame[0], self.frame[1]))
        if self.frame == "partition":
            return FOLDS[self.kind](c).over(whole)
        frame = w.rowsBetween if self.frame == "rows" else w.rangeBetween
        return FOLDS[self.kind](c).over(frame(Window.unboundedPreceding, Window.currentRow))


def _order(order_by: list) -> list[tuple[str, bool]]:
    """(column, falling) of ``"c"`` or ``("c", "desc")``."""
    pairs = [(o, "asc") if isinstance(o, str) else tuple(o) for o in order_by]
    if not pairs or any(d not in ("asc", "desc") for _, d in pairs):
        raise ValueError('order_by: column names or (name, "asc" or "desc")')
    return [(c, d == "desc") for c, d in pairs]


def _sorting(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{c}`").desc() if falling else F.col(f"`{c}`").asc() for c, falling in order]


def _keyed(df: DataFrame, partition_by: list[str], order: list[tuple[str, bool]]) -> tuple[DataFrame, list[Column]]:
    """``df`` and the order that keeps each key together."""
    return df, [*[F.col(f"`{g}`") for g in partition_by], *_sorting(order)]


def hot_keys(df: DataFrame, partition_by: list[str], bound: int) -> DataFrame:
    """Keys with more than ``bound`` rows (``__g_`` twins and their rows as
    ``__total``): at most rows / bound of them, so safe to broadcast."""
    counts = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__total")).where(F.col("__total") > bound)
    return counts.select(*[F.col(f"`{g}`").alias("__g_" + g) for g in partition_by], "__total")


def window(
    df: DataFrame,
    partition_by: list[str],
    order_by: list,
    functions: dict[str, Fn],
    rows_per_bucket: int = prefix.DEFAULT_ROWS_PER_BUCKET,
    hot: list[Row] | None = None,
) -> DataFrame:
    """``df`` with one column per entry of ``functions``.

    Equal to plain windows over ``partition_by`` in the order ``order_by``
    (column names or (name, "desc")); where several rows agree in the whole
    order, positions among them are as arbitrary as in a plain window. No
    partition columns: the whole table is one partition. ``hot`` hands over the
    rows of :func:`hot_keys` where several calls share the partition columns."""
    ensure_checkpoint_dir(df.sparkSession)
    order = _order(order_by)
    clash = functions.keys() & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    spec = Window.partitionBy(*[F.col(f"`{g}`") for g in partition_by])
    ordered = spec.orderBy(*_sorting(order))
    whole = spec

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[f.over(ordered, whole).alias(n) for n, f in functions.items()])

    if hot is None:
        hot = hot_keys(df, partition_by, rows_per_bucket).collect()
    if not hot:
        return plain(df)
    kinds = [T.StructField("__g_" + g, df.schema[g].dataType) for g in partition_by]
    schema = T.StructType([*kinds, T.StructField("__total", T.LongType())])
    keys = F.broadcast(df.sparkSession.createDataFrame(hot, schema))
    same = prefix._same_group(partition_by)
    cold = df.join(keys, same, "left_anti")
    mine = df.join(keys, same).drop(*["__g_" + g for g in partition_by])
    n = sum(r["__total"] for r in hot)
    return plain(cold).unionByName(_hot(mine, df.columns, partition_by, order, functions, rows_per_bucket, n))


def _hot(rows: DataFrame, columns: list[str], partition_by: list[str], order, functions: dict[str, Fn], per: int, n: int) -> DataFrame:
    rows, along = _keyed(rows, partition_by, order)
    peer = [f"`{c}`" for c in [*partition_by, *[c for c, _ in order]]]
    buckets, nb = prefix._bucketize(rows, along, rows_per_bucket=per, n=n, peers=peer)
    moving = {n: f for n, f in functions.items() if f.moving}
    if moving:
        back = max(f.reach()[0] for f in moving.values())
        ahead = max(f.reach()[1] for f in moving.values())
        buckets = prefix.sliding(
            buckets, lambda w: {n: f.over(w, None) for n, f in moving.items()}, _sorting(order), partition_by, back=back, ahead=ahead, cut=nb
        )
    rest = {n: f for n, f in functions.items() if not f.moving}
    if not rest:
        return buckets.select(*[F.col(f"`{c}`") for c in columns], *functions)
    spec = Window.partitionBy(*[F.col(f"`{g}`") for g in partition_by], BUCKET).orderBy(*_sorting(order))
    peers = Window.partitionBy(*[F.col(f"`{g}`") for g in partition_by], BUCKET, *[F.col(f"`{c}`") for c, _ in order])
    to_row = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_peers = spec.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {f.kind for f in rest.values()}
    own: dict[str, Column] = {"__n": F.row_number().over(spec)}
    if kinds & {"rank", "percent_rank", "cume_dist"}:
        own["__rank"] = F.rank().over(spec)
    if "dense_rank" in kinds:
        own["__dense"] = F.dense_rank().over(spec)
    if "cume_dist" in kinds:
        own["__peers"] = F.count(F.lit(1)).over(peers)
    # what a bucket hands on: name -> (aggregate, how later buckets fold it, over which buckets)
    carried = {"__n": (F.count(F.lit(1)), F.sum, "before")}
    if "__dense" in own:
        carried["__dense"] = (F.max("__dense"), F.sum, "before")
    for name, f in rest.items():
        if f.kind in POSITION:
            continue
        c = F.col(f"`{f.column}`")
        if f.kind in ("first", "last"):
            edge = (F.min_by if f.kind == "first" else F.max_by)(F.struct(c.alias("v")), "__n")
            carried["__c_" + name] = (edge, getattr(F, f.kind), "all")
            continue
        for kind in ("sum", "count") if f.kind == "avg" else (f.kind,):
            if f.frame != "partition":
                own[f"__{kind}_{name}"] = FOLDS[kind](c).over(to_row if f.frame == "rows" else to_peers)
            fold = FOLDS["sum" if kind == "count" else kind]
            carried[f"__c_{kind}_{name}"] = (FOLDS[kind](c), fold, "all" if f.frame == "partition" else "before")
    local = buckets.select("*", *[e.alias(n) for n, e in own.items()]).checkpoint(eager=True)

    # what each (key, bucket) gets from the buckets before it, and its whole key
    per_bucket = local.groupBy(*partition_by, BUCKET).agg(*[e.alias("__s" + n) for n, (e, _, _) in carried.items()])
    key = Window.partitionBy(*[F.col(f"`{g}`") for g in partition_by]).orderBy(BUCKET)
    over = {
        "before": key.rowsBetween(Window.unboundedPreceding, -1),
        "all": key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    given = []
    for n, (_, fold, where) in carried.items():
        e = fold(F.col(f"`__s{n}`")).over(over[where])
        given.append((F.coalesce(e, F.lit(0)) if n in ("__n", "__dense") else e).alias("__b" + n))
    carry = per_bucket.select(
        *[F.col(f"`{g}`").alias("__g_" + g) for g in partition_by], F.col(BUCKET).alias("__cb"), *given
    )
    out = local.join(F.broadcast(carry), prefix._same_group(partition_by) & (F.col(BUCKET) == F.col("__cb")))

    def folded(name: str, f: Fn, kind: str) -> Column:
        b = F.col(f"`__b__c_{kind}_{name}`")
        if f.frame == "partition":
            return b
        here = F.col(f"`__{kind}_{name}`")
        if kind in ("min", "max"):
            return (F.least if kind == "min" else F.greatest)(here, b)
        if kind == "count":
            return here + F.coalesce(b, F.lit(0))
        return F.when(b.isNull(), here).when(here.isNull(), b).otherwise(here + b)

    total, at = F.col("__total"), (F.col("__n") + F.col("__b__n")).cast("long")
    found = []
    for name, f in functions.items():
        if f.moving:
            found.append(F.col(f"`{name}`"))
            continue
        if f.kind == "row_number":
            v = at.cast("int")
        elif f.kind == "ntile":
            size, more = F.floor(total / f.n), total % f.n
            wide = more * (size + 1)
            v = F.when(at <= wide, F.floor((at - 1) / (size + 1)) + 1).otherwise(F.floor((at - wide - 1) / F.greatest(size, F.lit(1))) + more + 1)
            v = v.cast("int")
        elif f.kind == "dense_rank":
            v = (F.col("__dense") + F.col("__b__dense")).cast("int")
        elif f.kind in ("rank", "percent_rank", "cume_dist"):
            rank = F.col("__rank") + F.col("__b__n")
            v = rank.cast("int")
            if f.kind == "percent_rank":
                v = F.when(total > 1, (rank - 1) / (total - 1)).otherwise(0.0)
            elif f.kind == "cume_dist":
                v = (rank - 1 + F.col("__peers")) / total
        elif f.kind in ("first", "last"):
            v = F.col(f"`__b__c_{name}`")["v"]
        elif f.kind == "avg":
            v = F.try_divide(folded(name, f, "sum"), folded(name, f, "count"))
        else:
            v = folded(name, f, f.kind)
        found.append(v.alias(name))
    return out.select(*[F.col(f"`{c}`") for c in columns], *found)
