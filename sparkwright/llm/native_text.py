"""Text statistics as Column expressions (JVM only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACES

_SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable keeps
    the optimizer from repeating it for every element of an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE_CLASS + "+"), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, chars, "")), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """\\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(h: Column, width: int) -> Column:
    """Positions covered by the windows whose hash occurs twice or more."""
    rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def doubled(s: Column) -> Column:
        same = lambda x, i: F.get(s, i).getField("h").eqNullSafe(x["h"])
        at = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    steps = lambda p: F.transform(
        p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))
    )
    total = lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)
    return let(let(rows, doubled), total)


def repeated_words(word_array: Column, width: int = 5) -> Column:
    """Words covered by a window of ``width`` words found twice or more in the
    text, the first one included. Windows are compared by their 64-bit hash."""

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, each).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width))

    return let(let(word_array, hashes), count).cast("long")
