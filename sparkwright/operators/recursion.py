"""Recursive queries: ``WITH RECURSIVE ... UNION`` as semi-naive rounds.

Spark's own recursive CTE keeps duplicates (``UNION ALL``), so a cycle never
ends, and limits rounds and rows. Here a round works on the rows that the round
before it found for the first time, and the rounds end when there are none: on a
cycle too, since a row that is known is not new."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .intervaljoin import _counts, _spread

#: Rounds after which what was found is written as one table again.
COMPACT = 8


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """The rows of ``seed`` and all that ``step`` makes of them, again and again,
    each once (nulls equal nulls).

    ``step`` gets the new rows of a round and returns rows with the same columns;
    it has to be a sum over its rows (a join or filter, as SQL asks of a recursive
    term). Every round is checkpointed; only whether it found anything reaches
    the driver. ``max_rounds`` bounds the depth (None: to the end)."""
    ensure_checkpoint_dir(seed.sparkSession)
    new = seed.distinct().checkpoint(eager=True)
    parts, done = [new], 0
    while (max_rounds is None or done < max_rounds) and not new.isEmpty():
        known = reduce(DataFrame.unionAll, parts)
        new = step(new).select(*[F.col(f"`{c}`") for c in seed.columns]).subtract(known).checkpoint(eager=True)
        parts.append(new)
        done += 1
        if len(parts) > COMPACT:
            parts = [reduce(DataFrame.unionAll, parts).checkpoint(eager=True)]
    return reduce(DataFrame.unionAll, parts)


def _components(edges: DataFrame) -> DataFrame:
    """(node, comp): the nodes of ``edges`` (``__s``, ``__t``) that lie on cycles,
    with one node of their strongly connected component.

    In turns: edges that no cycle can use are dropped; each node takes the highest
    node (by hash) that reaches it; what reaches that node back over nodes that
    took the same is its component, and the other edges within what took the same
    go on. Every table is checkpointed; only counts reach the driver."""
    found, n = [], -1
    while True:
        while True:  # on a cycle each end is also the other end of an edge
            kept = edges.join(edges.select(F.col("__t").alias("__s")).distinct(), "__s", "left_semi")
            kept = kept.join(edges.select(F.col("__s").alias("__t")).distinct(), "__t", "left_semi")
            edges = kept.select("__s", "__t").checkpoint()
            before, n = n, edges.count()
            if n in (0, before):
                break
        if n == 0:
            break
        nodes = edges.select(F.col("__s").alias("node")).distinct()
        top = nodes.select("node", F.struct(F.xxhash64("node").alias("h"), "node").alias("top"), F.lit(True).alias("new")).checkpoint()
        while True:
            risen = top.where("new").join(edges, F.col("node") == F.col("__s")).groupBy(F.col("__t").alias("node")).agg(F.max("top").alias("m"))
            higher = F.coalesce(F.col("m") > F.col("top"), F.lit(False))
            top = top.join(risen, "node", "left").select("node", F.when(higher, F.col("m")).otherwise(F.col("top")).alias("top"), higher.alias("new"))
            top = top.checkpoint()
            if top.where("new").isEmpty():
                break
        top = top.select("node", F.col("top.node").alias("comp"))
        ends = [top.select(F.col("node").alias(e), F.col("comp").alias(f"{e}c")) for e in ("__s", "__t")]
        same = edges.join(ends[0], "__s").join(ends[1], "__t").where("__sc = __tc").select("__s", "__t").checkpoint()
        back = fixpoint(top.where("node = comp"), lambda new: new.join(same, F.col("node") == F.col("__t")).select(F.col("__s").alias("node"), "comp"))
        found.append(back.checkpoint())
        done = found[-1].select("node")
        edges = same.join(done, F.col("__s") == F.col("node"), "left_anti").join(done, F.col("__t") == F.col("node"), "left_anti")
    schema = edges.select(F.col("__s").alias("node"), F.col("__s").alias("comp"))
    return reduce(DataFrame.unionAll, found, schema.limit(0))


def reachable(edges: DataFrame, starts: DataFrame, source: str, target: str, start: str) -> DataFrame:
    """(start, node): every node that each start reaches along the edges, itself
    included. Null ends and starts lead nowhere. The edges are made once, not in
    every round.

    Nodes on common cycles reach the same, so the rounds run on strongly connected
    components; rows are listed once at the end, by members of the components, in
    tasks by their number."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).where("__s <> __t").distinct().checkpoint()
    starts = starts.where(F.col(start).isNotNull()).select(F.col(start).alias("start")).distinct().checkpoint()
    follow = lambda new: new.join(e, F.col("node") == F.col("__s")).select(F.col("__t").alias("node"))
    nodes = fixpoint(starts.select(F.col("start").alias("node")), follow).checkpoint()
    e = e.join(nodes.select(F.col("node").alias("__s")), "__s", "left_semi").checkpoint()
    members = nodes.join(_components(e), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")).checkpoint()
    ends = [members.select(F.col("node").alias(end), F.col("comp").alias(f"{end}c")) for end in ("__s", "__t")]
    links = e.join(ends[0], "__s").join(ends[1], "__t").where("__sc <> __tc").select("__sc", "__tc").distinct().checkpoint()
    starts = starts.join(members, F.col("start") == F.col("node")).select("start", F.col("comp").alias("__from"))
    reached = fixpoint(
        starts.select("__from", F.col("__from").alias("__to")).distinct(),
        lambda new: new.join(links, F.col("__to") == F.col("__sc")).select("__from", F.col("__tc").alias("__to")),
    )
    from_n = starts.groupBy("__from").agg(F.count(F.lit(1)).cast("double").alias("__np"))
    points = reached.join(from_n, "__from").groupBy(F.col("__to").alias("__k0")).agg(F.sum("__np").alias("__np"))
    dealt, cut = _spread(
        starts.join(reached, "__from").select("start", "__to"), members, points, _counts(members, ["comp"], "__ni"), ["__to"], ["comp"], 1
    )
    same = [F.col(a) == F.col(b) for a, b in (("__to", "comp"), ("__lp", "__rp"), ("__li", "__ri"))]
    return dealt.join(cut, same).select("start", "node")
