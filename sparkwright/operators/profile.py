"""Profiling (P01-P10): wide single-pass aggregates, long-form results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import categorical_columns, numeric_columns, value_or_null
from ..functions.stats import sample_kurtosis, sample_skewness
from ..session import ensure_checkpoint_dir
from . import prefix
from .cleaning import q
from .quality import missing_by_column
from .quantiles import column_quantiles
from .topk import top_k_per_group
from .transform import RANK_BROADCAST_ROWS, _rank_type, average_ranks

PROFILE_PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
PCT_NAMES = ["p1", "p5", "p25", "p50", "p75", "p95", "p99"]
AGG_CHUNK = 100  # aggregate expressions per job stay under the codegen limits

DESC_SCHEMA = T.StructType(
    [T.StructField("column", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ["count", "mean", "std", "min", *PCT_NAMES, "max", "skewness", "kurtosis"]]
    + [T.StructField("missing", T.LongType()), T.StructField("missing_pct", T.DoubleType())]
)


def _quantile_stats(mom: dict[str, dict], cols: list[str]) -> dict[tuple, tuple]:
    """(n, min, max) per column from the moments pass, for exact_quantiles."""
    return {(c,): (mom[c]["count"], mom[c]["min"], mom[c]["max"]) for c in cols}


def _moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """count / mean / std / min / max / skew / kurtosis / nulls of every column.

    Long form (column, value), at most AGG_CHUNK columns at once: one aggregate of
    seven expressions, however many columns, stays within compiled code."""
    out = {}
    for start in range(0, len(cols), AGG_CHUNK):
        chunk = cols[start : start + AGG_CHUNK]
        each = F.array(*[F.struct(F.lit(i).alias("i"), value_or_null(df, c).cast("double").alias("x")) for i, c in enumerate(chunk)])
        long, x = df.select(F.explode(each).alias("p")).select("p.i", "p.x"), F.col("x")
        found = long.groupBy("i").agg(
            F.count(F.lit(1)).alias("rows"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), sample_skewness(x).alias("skewness"), sample_kurtosis(x).alias("kurtosis"),
        )
        empty = dict(rows=0, count=0, mean=None, std=None, min=None, max=None, skewness=None, kurtosis=None)
        out.update({c: dict(empty) for c in chunk})
        for r in found.collect():
            out[chunk[r["i"]]] = {k: r[k] for k in empty}
    return out


def descriptive_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column (pandas describe + skew, kurtosis, missing)."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], DESC_SCHEMA)
    mom = _moments(df, cols)
    qs = column_quantiles(df, cols, PROFILE_PERCENTILES, stats=_quantile_stats(mom, cols))
    rows = []
    for c in cols:
        m = mom[c]
        n = m["rows"]
        miss = n - m["count"]
        rows.append(
            (
                c,
                float(m["count"]),
                m["mean"],
                m["std"],
                m["min"],
                *qs[c],
                m["max"],
                m["skewness"],
                m["kurtosis"],
                int(miss),
                round(miss / n * 100, 2) if n else 0.0,
            )
        )
    return spark.createDataFrame(rows, DESC_SCHEMA)


def correlation_long(df: DataFrame, method: str = "pearson", columns: list[str] | None = None, **kw) -> DataFrame:
    """P02 as long form (col1, col2, corr), full matrix including the diagonal.

    Pearson: pairwise complete, one aggregate in long form (:func:`_corr_of`).
    Spearman: Pearson over average ranks among the rows that have both values.
    Pairs that share their rows share the ranks of their columns; all such sets of
    rows are ranked in one pass (:func:`_shared_spearman`). Beyond SHARED_RANKS
    the pairs are ranked anew in long form (:func:`_pairwise_spearman`).
    Kendall: exact tau-b per pair (see :mod:`kendall`)."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    schema = "col1 string, col2 string, corr double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    if method == "kendall":
        from .kendall import kendall_long

        return kendall_long(df, cols, **kw)
    base = df.select(*[value_or_null(df, c).cast("double").alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    vals = {}
    if method == "spearman":
        base = df.select(*[value_or_null(df, c).alias(c) for c in cols])
        shared = _pairs_by_rows(base, cols, pairs)
        if len(shared) <= WIDE_ROW_SETS and sum(len({c for p in own for c in p}) for own in shared) <= SHARED_RANKS:
            vals = _shared_spearman(base, shared, **kw)
        else:
            apart = _pairs_with_own_ranks(base, cols, pairs)
            vals = _pairwise_spearman(base, apart, **kw)
            vals.update(_wide_spearman(base, [p for p in pairs if p not in vals], **kw))
        pairs = []
    elif method != "pearson":
        raise ValueError("method must be pearson, spearman or kendall")
    vals.update(_corr_of(base, pairs))
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                rows.append((a, b, 1.0))
            else:
                rows.append((a, b, vals.get((a, b), vals.get((b, a)))))
    return spark.createDataFrame(rows, schema)


def _corr_of(base: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each pair, over the rows that have both values; null
    where one of them does not vary (``corr`` itself raises there under ANSI).

    Long form (pair, x, y): three aggregates whatever the number of pairs, in place
    of three for each, which no longer compile."""
    vals = {p: None for p in pairs}
    for start in range(0, len(pairs), AGG_CHUNK):
        chunk = pairs[start : start + AGG_CHUNK]
        each = [F.struct(F.lit(i).alias("i"), q(a).alias("x"), q(b).alias("y")) for i, (a, b) in enumerate(chunk)]
        long = base.select(F.explode(F.array(*each)).alias("p")).select("p.i", "p.x", "p.y").where("x is not null and y is not null")
        corr = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
        vals.update((chunk[r["i"]], r["corr"]) for r in long.groupBy("i").agg(corr.alias("corr")).collect())
    return vals


#: Sets of rows that pairs share, and ranks that a row then has, up to which the
#: columns are ranked over all sets at once.
WIDE_ROW_SETS = 60
SHARED_RANKS = 150
#: Patterns of missing values up to which pairs are told apart by their rows.
NULL_PATTERNS = 10_000


def _pairs_by_rows(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Pairs grouped by the rows that have both values, from the patterns of
    missing values; each pair by itself where there are too many patterns."""
    if len(cols) > 60:
        return [[p] for p in pairs]
    mask = sum((q(c).isNotNull().cast("long") * (1 << i) for i, c in enumerate(cols)), F.lit(0).cast("long"))
    seen = [r[0] for r in df.select(mask.alias("m")).distinct().limit(NULL_PATTERNS + 1).collect()]
    if len(seen) > NULL_PATTERNS:
        return [[p] for p in pairs]
    at = {c: 1 << i for i, c in enumerate(cols)}
    groups: dict[frozenset, list] = {}
    for a, b in pairs:
        groups.setdefault(frozenset(m for m in seen if m & at[a] and m & at[b]), []).append((a, b))
    return list(groups.values())


def _shared_spearman(base: DataFrame, sets: list[list[tuple[str, str]]], **kw) -> dict[tuple[str, str], float | None]:
    """Pairs by the sets of rows that they share (see :func:`_pairs_by_rows`).

    Each value of a column is counted once with its rows in every set; one running
    count along the values gives its average rank in each. The ranks go back to
    the rows by one join per column, however many pairs use it; tables of few
    values are broadcast."""
    ensure_checkpoint_dir(base.sparkSession)
    uses: dict[str, list[int]] = {}
    for i, own in enumerate(sets):
        for c in dict.fromkeys(c for p in own for c in p):
            uses.setdefault(c, []).append(i)
    kinds: dict[str, list[str]] = {}
    for c in uses:
        kinds.setdefault(_rank_type(base.schema[c].dataType), []).append(c)
    at = {c: j for j, c in enumerate(uses)}
    tables = []
    for kind, cols in kinds.items():
        mine = sorted({i for c in cols for i in uses[c]})
        within = [(q(sets[i][0][0]).isNotNull() & q(sets[i][0][1]).isNotNull()).cast("long").alias(f"__n{i}") for i in mine]
        value = F.explode(F.array(*[F.struct(F.lit(at[c]).alias("c"), q(c).cast(kind).alias("v")) for c in cols])).alias("__p")
        long = base.select(value, *within).where(F.col("__p.v").isNotNull())
        counts = long.groupBy(F.col("__p.c").alias("__c"), F.col("__p.v").alias("__v")).agg(*[F.sum(f"__n{i}").alias(f"__n{i}") for i in mine])
        counts = counts.checkpoint(eager=True)
        size = {r["__c"]: r["count"] for r in counts.groupBy("__c").count().collect()}
        upto = {f"__u{i}": ("sum", f"__n{i}") for i in mine}
        ranks = prefix.running(counts, upto, ["__v"], ["__c"], n=sum(size.values()), **kw)
        for c in cols:
            own = [(F.col(f"__u{i}") - (F.col(f"__n{i}") - 1) / 2.0).alias(f"__r{at[c]}_{i}") for i in uses[c]]
            tables.append((size.get(at[c], 0), c, kind, ranks.where(F.col("__c") == at[c]).select(F.col("__v").alias("__k"), *own)))
    out = base
    for size, c, kind, r in sorted(tables, key=lambda t: -t[0]):  # joins that shuffle come first, on narrow rows
        r = F.broadcast(r) if size <= RANK_BROADCAST_ROWS else r
        out = out.join(r, q(c).cast(kind) == F.col("__k"), "left").drop("__k", c)
    wanted = {(a, b): (f"__r{at[a]}_{i}", f"__r{at[b]}_{i}") for i, own in enumerate(sets) for a, b in own}
    found = _corr_of(out, list(wanted.values()))
    return {p: found[w] for p, w in wanted.items()}


def _wide_spearman(rows: DataFrame, pairs: list[tuple[str, str]], **kw) -> dict[tuple[str, str], float | None]:
    """Pairs for which the ranks of each column over ``rows`` serve."""
    own = list(dict.fromkeys(c for p in pairs for c in p))
    if not own:
        return {}
    ranked = average_ranks(rows.select(*map(q, own)), own, ascending=True, names={c: "__r_" + c for c in own}, **kw)
    return _corr_of(ranked.select(*[F.col(f"`__r_{c}`").alias(c) for c in own]), pairs)


def _pairs_with_own_ranks(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs for which one column has values on rows that lack the other."""
    counts = {}
    wanted = [(c, c) for c in cols] + pairs
    for start in range(0, len(wanted), AGG_CHUNK):
        chunk = wanted[start : start + AGG_CHUNK]
        row = df.select(*[F.count_if(q(a).isNotNull() & q(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(chunk)]).first()
        counts.update(zip(chunk, row))
    return [(a, b) for a, b in pairs if not counts[a, b] == counts[a, a] == counts[b, b]]


def _order_value(df: DataFrame, column: str) -> list:
    """A number as (high, low, real), which order as the values do and keep any
    two apart: integers are high, decimals cut by digits, others real."""
    kind, c, zero = df.schema[column].dataType, q(column), F.lit(0).cast("long")
    if isinstance(kind, T.DecimalType):  # its 38 digits, cut as 18, 18 and 2
        digits = F.lpad(F.translate(F.abs(c).cast("string"), ".", ""), 38, "0")
        sign = F.signum(c).cast("int")
        return [
            F.substring(digits, 1, 18).cast("long") * sign, F.substring(digits, 19, 18).cast("long") * sign,
            F.substring(digits, 37, 2).cast("double") * sign,
        ]
    if isinstance(kind, T.IntegralType):
        return [c.cast("long"), zero, F.lit(0.0)]
    return [zero, zero, c.cast("double")]


def _pairwise_spearman(df: DataFrame, pairs: list[tuple[str, str]], **kw) -> dict[tuple[str, str], float | None]:
    """Spearman correlation of each pair over the rows that have both values.

    Long form, whatever the number of pairs: rows become (pair, value, value),
    equal ones counted before anything moves; the values of a side are counted
    and a running count along them (keyed by pair and side, in range buckets)
    gives their average ranks; ranks go back to the counted value pairs by
    shuffle joins, and one aggregate of centred ranks ends it."""
    ensure_checkpoint_dir(df.sparkSession)
    names = ["h", "l", "x"]
    points = []
    for i, (a, b) in enumerate(pairs):
        sides = [_order_value(df, c) for c in (a, b)]
        value = F.struct(
            F.lit(i).alias("pair"), *[v.alias(n + s) for s, own in zip("ab", sides) for n, v in zip(names, own)]
        )
        points.append(F.when(q(a).isNotNull() & q(b).isNotNull(), value))
    keys = ["pair"] + [n + s for s in "ab" for n in names]
    long = df.select(F.explode(F.array(*points)).alias("p")).where(F.col("p").isNotNull()).select("p.*")
    counted = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    both = [F.struct(F.lit(s).alias("side"), *[F.col(n + s).alias(n) for n in names]) for s in "ab"]
    sides = counted.select("pair", "n", F.explode(F.array(*both)).alias("v")).select("pair", "n", "v.*")
    own = sides.groupBy("pair", "side", *names).agg(F.sum("n").alias("n")).checkpoint(eager=True)
    ranks = prefix.running(own, {"upto": ("sum", "n")}, names, group_by=["pair", "side"], **kw)
    ranks = ranks.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    joined = counted
    for s in "ab":
        mine = ranks.where(F.col("side") == s).select("pair", *[F.col(n).alias(n + s) for n in names], F.col("rank").alias("r" + s))
        joined = joined.join(mine, ["pair", *[n + s for n in names]])
    total = counted.groupBy("pair").agg(F.sum("n").alias("total"))  # one row a pair
    mid = (F.col("total") + 1) / 2.0
    x, y, n = F.col("ra") - mid, F.col("rb") - mid, F.col("n")
    sums = joined.join(F.broadcast(total), "pair").groupBy("pair").agg(
        F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy")
    )
    found = sums.select("pair", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("corr")).collect()
    return {p: None for p in pairs} | {pairs[r["pair"]]: r["corr"] for r in found}


def value_counts(df: DataFrame, top_n: int = 10, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per column: dtype, unique; top values per column with rank).

    Long form (column, value as text) counted with partial aggregation; the
    top-n per column is salted so a high-cardinality column is ranked in
    parallel. Ties: count desc, value asc."""
    cols = columns or df.columns
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value_or_null(df, c).cast("string").alias("value")) for c in cols])).alias("p")
    ).select("p.column", "p.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    top = top_k_per_group(counts, ["column"], [F.col("count").desc(), F.col("value").asc()], top_n)
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in cols], "column string, dtype string"
    )
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    info = types.join(uniq, "column", "left").select("column", "dtype", F.coalesce("unique", F.lit(0)).alias("unique"))
    return info, top


def missing_patterns(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct) for columns with nulls, most first."""
    per = missing_by_column(df)
    n = df.select(F.count(F.lit(1)).alias("__n"))
    return (
        per.where(F.col("missing_count") > 0)
        .crossJoin(n)
        .select(
            "column",
            "missing_count",
            F.when(F.col("__n") > 0, F.round(F.col("missing_count") / F.col("__n") * 100, 2)).otherwise(0.0).alias("missing_pct"),
        )
        .orderBy(F.col("missing_count").desc(), "column")
    )


def overview(df: DataFrame) -> DataFrame:
    """P05 overview: rows, columns, duplicate_rows (extra copies), duplicate_pct."""
    n = df.select(F.count(F.lit(1)).alias("rows"))
    d = df.dropDuplicates().select(F.count(F.lit(1)).alias("distinct_rows"))
    return n.crossJoin(d).select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        (F.col("rows") - F.col("distinct_rows")).cast("long").alias("duplicate_rows"),
        F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("distinct_rows")) / F.col("rows") * 100, 2))
        .otherwise(0.0)
        .alias("duplicate_pct"),
    )


def full_profile(df: DataFrame) -> dict[str, DataFrame]:
    """Named DataFrames sharing one input."""
    info, top = value_counts(df)
    return {
        "overview": overview(df),
        "column_types": df.sparkSession.createDataFrame(
            [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string"
        ),
        "missing": missing_patterns(df),
        "numeric_stats": descriptive_stats(df),
        "correlation": correlation_long(df),
        "value_counts_info": info,
        "value_counts": top,
    }


def infer_schema(df: DataFrame, order_by: list[str] | None = None, samples: int = 3) -> DataFrame:
    """Per column name, dtype, nullable, unique_count, null_count,
    sample_values (first ``samples`` non-null by ``order_by``, else smallest),
    min / max for numeric columns."""
    cols = df.columns
    nums = set(numeric_columns(df, include_bool=False))
    # internal names are reserved so an order column may be called anything
    order = [f"__o{i}" for i in range(len(order_by or []))]
    long = df.select(
        *[q(o).alias(a) for o, a in zip(order_by or [], order)],
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), value_or_null(df, c).cast("string").alias("v")) for c in cols])).alias("__p"),
    ).select(*order, F.col("__p.k").alias("__column"), F.col("__p.v").alias("__value")).where(F.col("__value").isNotNull())
    # one distinct (column, value) table feeds both the unique counts and, without
    # an order key, the samples (the same exchange is reused in the plan)
    dv = long.select("__column", "__value").distinct()
    uniq = dv.groupBy("__column").agg(F.count(F.lit(1)).alias("unique_count")).withColumnRenamed("__column", "column")
    if order_by:
        smp = top_k_per_group(long, ["__column"], [F.col(o) for o in order], samples, rank_col="__r")
    else:
        smp = top_k_per_group(dv, ["__column"], [F.col("__value")], samples, rank_col="__r")
    smp = smp.groupBy("__column").agg(F.sort_array(F.collect_list(F.struct("__r", "__value"))).alias("__s"))
    smp = smp.select(F.col("__column").alias("column"), F.transform("__s", lambda s: s["__value"]).alias("sample_values"))
    stats = df.select(
        F.count(F.lit(1)).alias("__n"),
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.min(q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cols) if c in nums],
        *[F.max(q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cols) if c in nums],
    )
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = f.name
        nulls = (F.col("__n") - F.col(f"n{i}")).cast("long")
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (nulls > 0).alias("nullable"),
                nulls.alias("null_count"),
                (F.col(f"lo{i}") if c in nums else F.lit(None).cast("double")).alias("min"),
                (F.col(f"hi{i}") if c in nums else F.lit(None).cast("double")).alias("max"),
            )
        )
    base = stats.select(F.explode(F.array(*structs)).alias("p")).select("p.*")
    return (
        base.join(uniq, "column", "left")
        .join(smp, "column", "left")
        .select(
            "position", "column", "dtype", "nullable",
            F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
            "null_count",
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            "min", "max",
        )
        .orderBy("position")
    )


def summarize_all(df: DataFrame) -> DataFrame:
    """describe(include='all'): numeric stats, and count / unique / top / freq
    for text columns (top = most frequent, smallest on ties)."""
    spark = df.sparkSession
    nums = numeric_columns(df)
    cats = categorical_columns(df)
    schema = T.StructType(
        [T.StructField("column", T.StringType()), T.StructField("count", T.LongType()),
         T.StructField("unique", T.LongType()), T.StructField("top", T.StringType()), T.StructField("freq", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in ["mean", "std", "min", "p25", "p50", "p75", "max"]]
    )
    rows = []
    if nums:
        mom = _moments(df, nums)
        qs = column_quantiles(df, nums, [0.25, 0.5, 0.75], stats=_quantile_stats(mom, nums))
        for c in nums:
            m = mom[c]
            rows.append((c, int(m["count"]), None, None, None, m["mean"], m["std"], m["min"], *qs[c], m["max"]))
    if cats:
        info, top = value_counts(df, top_n=1, columns=cats)
        counts = df.select(*[F.count(q(c)).alias(c) for c in cats]).first()
        tops = {r["column"]: (r["value"], r["count"]) for r in top.collect()}
        uniq = {r["column"]: r["unique"] for r in info.collect()}
        for c in cats:
            t = tops.get(c, (None, None))
            rows.append((c, int(counts[c]), int(uniq.get(c, 0)), t[0], t[1], None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, schema)


def notable_correlations(df: DataFrame, threshold: float = 0.3, top: int = 10) -> DataFrame:
    """Pairs (in column order) with |r| > threshold, strongest ``top``."""
    cols = numeric_columns(df)
    pos = {c: i for i, c in enumerate(cols)}
    long = correlation_long(df, columns=cols)
    order = df.sparkSession.createDataFrame([(c, i) for c, i in pos.items()], "c string, i int")
    a = long.join(order.withColumnRenamed("c", "col1").withColumnRenamed("i", "i1"), "col1").join(
        order.withColumnRenamed("c", "col2").withColumnRenamed("i", "i2"), "col2"
    )
    return (
        a.where((F.col("i1") < F.col("i2")) & (F.abs("corr") > threshold))
        .orderBy(F.abs("corr").desc(), "i1", "i2")
        .limit(top)
        .select("col1", "col2", "corr")
    )


def group_summary(df: DataFrame, max_measures: int = 4) -> DataFrame:
    """Mean, sum, count (2 decimals) of up to 4 numeric columns by the
    first text column, long form (group, column, mean, sum, count)."""
    cats = categorical_columns(df)
    nums = numeric_columns(df)[:max_measures]
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], "group string, column string, mean double, sum double, count long")
    g = cats[0]
    agg = df.where(q(g).isNotNull()).groupBy(q(g).alias("group")).agg(
        *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(nums)],
        *[F.sum(q(c)).cast("double").alias(f"s{i}") for i, c in enumerate(nums)],
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(nums)],
    )
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.round(F.col(f"m{i}"), 2).alias("mean"),
            F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 2).alias("sum"),
            F.col(f"n{i}").cast("long").alias("count"),
        )
        for i, c in enumerate(nums)
    ]
    return agg.select("group", F.explode(F.array(*parts)).alias("p")).select("group", "p.*")


def numeric_context(df: DataFrame) -> DataFrame:
    """Mean, median, min, max, std, missing, unique per numeric column."""
    cols = numeric_columns(df)
    spark = df.sparkSession
    schema = "column string, mean double, median double, min double, max double, std double, missing long, unique long"
    if not cols:
        return spark.createDataFrame([], schema)
    mom = _moments(df, cols)
    med = column_quantiles(df, cols, [0.5], stats=_quantile_stats(mom, cols))
    uniq = df.select(*[F.countDistinct(q(c)).alias(c) for c in cols]).first()
    rows = [
        (c, mom[c]["mean"], med[c][0], mom[c]["min"], mom[c]["max"], mom[c]["std"],
         int(mom[c]["rows"] - mom[c]["count"]), int(uniq[c]))
        for c in cols
    ]
    return spark.createDataFrame(rows, schema)


def categorical_context(df: DataFrame, max_columns: int = 8, top_n: int = 8) -> DataFrame:
    """Top 8 values of up to 8 text columns with the column's unique count."""
    cats = categorical_columns(df)[:max_columns]
    if not cats:
        return df.sparkSession.createDataFrame([], "column string, unique long, value string, count long, rank int")
    info, top = value_counts(df, top_n=top_n, columns=cats)
    return top.join(info.select("column", "unique"), "column").select("column", "unique", "value", "count", "rank")
