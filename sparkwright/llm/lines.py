"""Line dedup by distinct-site spread: lines that stand on many sites are
boilerplate. Each line hash gathers a HyperLogLog sketch of its sites (merged
map-side and after the shuffle); lines whose estimate is near the threshold
get an exact distinct count. All of it is DataFrame work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut
from .native_text import let

MIN_SITES = 10
LG_K = 9
#: Relative distance from the threshold within which sites are counted
#: exactly: over eight standard errors of a sketch with 2 ** LG_K registers.
NEAR = 0.4


#: Lines up to which a table of them is broadcast (a few MB); beyond, all lines
#: are shuffled to it instead.
BROADCAST_LINES = 50_000


def if_small(found: DataFrame, rows: int = BROADCAST_LINES) -> DataFrame:
    """``found`` with a broadcast hint where it has few enough rows: then no
    line moves, however many documents share it."""
    return F.broadcast(found) if found.count() <= rows else found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as (i, x, site-independent row): i and x name a row; rows that
    share both have the same id and text, and so the same answer."""
    kind = docs.schema[id_col].dataType.typeName()
    own = F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.lit(None).cast("long")
    text = F.col(text_col).cast("string")
    return docs.select(
        F.coalesce(own, F.xxhash64(F.col(id_col), text)).alias("i"), F.hash(text).alias("x"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"),
    )


def _lines(keyed: DataFrame, site_col: str) -> DataFrame:
    """(i, x, site, pos, h, g) of each line with a word: h and g are two
    hashes of the line without the white space around it."""
    line = F.btrim("line", F.lit(SPACES))
    return (
        keyed.select("i", "x", F.col(f"doc.`{site_col}`").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length(line) > 0)
        .select("i", "x", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """(h, g, first): the lines on ``min_sites`` distinct sites or more, with
    the coordinates (i, x, pos) of the smallest occurrence. A null site counts
    as no site."""
    spread = (
        lines.groupBy("h", "g")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"),
            F.min(F.struct("i", "x", "pos")).alias("first"),
        )
        .where(F.col("n") >= min_sites)
        .select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - near))
    )
    spread = cut(spread)
    sure = spread.where(F.col("sites") > min_sites * (1 + near)).select("h", "g", "first")
    close = spread.where(F.col("sites") <= min_sites * (1 + near)).select("h", "g", "first")
    pairs = lines.join(if_small(close.select("h", "g")), ["h", "g"], "left_semi").select("h", "g", "site").distinct()
    exact = pairs.groupBy("h", "g").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(sure.unionByName(close.join(exact.select("h", "g"), ["h", "g"])))


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    keep_first: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (struct of all its columns but the
    text), ``text`` without boilerplate lines, n_lines and n_removed.

    Boilerplate is a line (white space around it aside) with a word that
    stands on ``min_sites`` distinct sites or more; every occurrence goes but,
    with ``keep_first``, the smallest by (id, line number), so that a text
    copied to many sites survives once. Lines without a word stay. Null texts
    stay null; null sites are no site; rows with a null id are documents like
    others; rows that repeat id and text are treated alike. Empty: empty."""
    keyed = _keyed(docs, id_col, text_col)
    lines = _lines(keyed, site_col)
    found = boilerplate(lines, min_sites)
    here = F.struct("i", "x", "pos")
    hits = lines.select("i", "x", "pos", "h", "g").join(if_small(found), ["h", "g"])
    if keep_first:
        hits = hits.where(here != F.col("first"))
    gone = hits.groupBy("i", "x").agg(F.collect_set("pos").alias("gone"))
    all_lines = F.split("text", "\n")
    kept = let(
        all_lines,
        lambda a: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda p: F.get(a, p)), "\n"
        ),
    )
    return keyed.join(gone, ["i", "x"], "left").select(
        "doc",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
