"""Document text as Spark jobs. Input is page text keyed by
(document, page); PDF decoding and OCR are outside the engine.

Every operator works per page or per (document, page) row, so the work
spreads over pages. A document's full text is never one cell: it comes in chunks
of bounded length (:func:`full_text`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_unicode as strip_ws
from ..operators import prefix

# Fixed values from the reference: the heading rule (matched at the start of a
# stripped line shorter than 120 characters) and the financial-figure pattern
# (case-insensitive; groups: label, value, unit).
HEADING_PATTERN = r"^(?:(?:\d+\.?\s+)|(?:[A-Z][A-Z\s]{3,})|(?:Chapter\s+\d+)|(?:Section\s+\d+))"
HEADING_MAX_LEN = 120
FIGURE_PATTERN = (
    r"(?i)([A-Za-z][A-Za-z\s&/'-]{2,60}?)\s*[:\-]?\s*"
    r"(?:Rs\.?|₹|\$|EUR|GBP)?\s*"
    r"([\d,]+(?:\.\d+)?)\s*"
    r"(crores?|lakhs?|millions?|billions?|mn|bn|cr)?"
)
SCANNED_CHARS = 50  # pages with fewer characters count as image-only / need OCR
# Characters that can occur inside a figure match (the pattern's classes and
# literals); every other character splits a page into independent segments.
FIGURE_CHARS = r"A-Za-zſK\d\s&/'\-:.,₹$"
# The rules are Unicode-aware: white space and digits of any script count.
UNICODE = "(?U)"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores before CPU-heavy per-row text work
    when the input has fewer partitions than cores (a few large files). On a
    cluster reading many files this is a no-op: no shuffle is added."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df


def page_text(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(document, page, text, char_count, source='embedded') for non-empty pages."""
    t = strip_ws(F.col(text))
    out = df.select(F.col(doc).alias("document"), F.col(page).alias("page"), t.alias("text"))
    return out.where(F.col("text") != "").select(
        "document", "page", "text", F.length("text").alias("char_count"), F.lit("embedded").alias("source")
    )


def scanned_documents(pages: DataFrame, threshold: int = SCANNED_CHARS) -> DataFrame:
    """Share of pages with fewer than ``threshold`` characters; scanned when > 0.5."""
    short = (F.length(strip_ws(F.coalesce(F.col("text"), F.lit("")))) < threshold).cast("long")
    agg = pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"), F.sum(short).alias("short_pages"))
    return agg.select(
        "document", "pages", "short_pages", (F.col("short_pages") / F.col("pages") > 0.5).alias("is_scanned")
    )


def text_with_fallback(spine: DataFrame, embedded: DataFrame, ocr: DataFrame, threshold: int = SCANNED_CHARS) -> DataFrame:
    """Per page embedded text when it has >= ``threshold`` characters, else
    OCR text when non-empty, else an empty row. All inputs keyed by (document, page)."""
    e = embedded.select("document", "page", strip_ws(F.col("text")).alias("e_text"))
    o = ocr.select("document", "page", strip_ws(F.col("text")).alias("o_text"))
    j = spine.select("document", "page").join(e, ["document", "page"], "left").join(o, ["document", "page"], "left")
    use_e = F.col("e_text").isNotNull() & (F.length("e_text") >= threshold)
    use_o = F.col("o_text").isNotNull() & (F.col("o_text") != "")
    txt = F.when(use_e, F.col("e_text")).when(use_o, F.col("o_text")).otherwise(F.lit(""))
    src = F.when(use_e, "embedded").when(use_o, "ocr").otherwise("empty")
    return j.select("document", "page", txt.alias("text"), F.length(txt).alias("char_count"), src.alias("source"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Stripped non-blank lines with their position and heading flag."""
    lines = spread(pages).select("document", "page", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "raw"))
    lines = lines.select("document", "page", "pos", strip_ws(F.col("raw")).alias("line")).where(F.col("line") != "")
    is_head = F.col("line").rlike(UNICODE + HEADING_PATTERN) & (F.length("line") < HEADING_MAX_LEN)
    return lines.withColumn("is_heading", is_head)


def sections(pages: DataFrame) -> DataFrame:
    """(document, page, section_no, heading, text). A heading line opens a
    section; lines before the first heading form one with heading ''; a section
    is emitted only when content lines follow its heading. Everything happens
    within the row of a page: its lines are an array that is cut at its headings,
    so no line moves."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip_ws), lambda x: x != "")
    rows = spread(pages).select("document", "page", lines.alias("l")).where(F.size("l") > 0)
    is_head = lambda x: x.rlike(UNICODE + HEADING_PATTERN) & (F.length(x) < HEADING_MAX_LEN)
    numbered = F.transform("l", lambda x, i: F.when(is_head(x), i + 1))
    rows = rows.withColumn("at", F.concat(F.array(F.lit(0)), F.filter(numbered, lambda i: i.isNotNull())))
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("l") + 1))
    rows = rows.select("document", "page", "l", F.posexplode(F.arrays_zip(F.col("at"), ends.alias("end"))).alias("section_no", "s"))
    first, size = F.col("s.at") + 1, F.col("s.end") - F.col("s.at") - 1
    return rows.where(size > 0).select(
        "document", "page", F.col("section_no").cast("long").alias("section_no"),
        F.when(F.col("section_no") == 0, "").otherwise(F.get("l", F.col("s.at") - 1)).alias("heading"),
        F.array_join(F.slice("l", first, size), "\n").alias("text"),
    )


def headings(pages: DataFrame) -> DataFrame:
    """D04 companion: every heading line (document, page, pos, heading)."""
    return page_lines(pages).where("is_heading").select("document", "page", "pos", F.col("line").alias("heading"))


def figures(pages: DataFrame) -> DataFrame:
    """(document, page, label, value, unit) from the figure pattern; values
    without a number, zero values and labels under 3 characters are skipped;
    (label, value) repeats keep the first occurrence per document."""
    # A usable figure needs a digit, and no match can contain a character
    # outside FIGURE_CHARS, so each page is cut at those characters into
    # segments that are matched independently (the same matches as a scan of
    # the whole page), and only segments with a digit are scanned. Whole
    # matches are found in one pass; the groups are then read from each short
    # match -- the pattern has no anchors or look-around, so re-matching a
    # match from its start yields the same groups.
    cand = spread(pages.where(F.col("text").rlike(UNICODE + r"\d")))
    segs = cand.select(
        "document", "page", F.posexplode(F.split("text", f"{UNICODE}[^{FIGURE_CHARS}]+")).alias("seg", "s")
    ).where(F.col("s").rlike(UNICODE + r"\d"))
    m = segs.select(
        "document", "page", "seg", F.posexplode(F.regexp_extract_all("s", F.lit(UNICODE + FIGURE_PATTERN), 0)).alias("pos", "mt")
    )
    x = m.select(
        "document", "page", F.struct("seg", "pos").alias("pos"),
        strip_ws(F.regexp_extract("mt", UNICODE + FIGURE_PATTERN, 1)).alias("label"),
        F.regexp_replace(F.regexp_extract("mt", UNICODE + FIGURE_PATTERN, 2), ",", "").try_cast("double").alias("value"),
        F.lower(F.regexp_extract("mt", UNICODE + FIGURE_PATTERN, 3)).alias("unit"),
    )
    x = x.where(F.col("value").isNotNull() & (F.col("value") != 0) & (F.length("label") >= 3))
    first = x.groupBy("document", "label", "value").agg(F.min_by(F.struct("page", "unit"), F.struct("page", "pos")).alias("k"))
    return first.select("document", F.col("k.page").alias("page"), "label", "value", F.col("k.unit").alias("unit"))


def document_summary(pages: DataFrame, secs: DataFrame | None = None, figs: DataFrame | None = None) -> DataFrame:
    """Per document total_pages, pages_with_text, sections_found,
    figures_found and full_text_chars (length of the pages joined by a blank line)."""
    base = pages.groupBy("document").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count(F.when(F.col("char_count") > 0, 1)).alias("pages_with_text"),
        (F.sum("char_count") + 2 * (F.count(F.lit(1)) - 1)).alias("full_text_chars"),
    )
    secs = secs if secs is not None else sections(pages)
    figs = figs if figs is not None else figures(pages)
    s = secs.groupBy("document").agg(F.count(F.lit(1)).alias("sections_found"))
    f = figs.groupBy("document").agg(F.count(F.lit(1)).alias("figures_found"))
    return base.join(s, "document", "left").join(f, "document", "left").select(
        "document", "total_pages", "pages_with_text",
        F.coalesce("sections_found", F.lit(0)).alias("sections_found"),
        F.coalesce("figures_found", F.lit(0)).alias("figures_found"),
        "full_text_chars",
    )


#: Characters of a chunk of full text.
CHUNK_CHARS = 1 << 20


def full_text(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, **kw) -> DataFrame:
    """The full text of each document, its pages in order joined by a blank
    line, as (document, chunk, start, text): chunks of ``chunk_chars`` characters
    (the last one shorter) that concatenate to it. Page offsets are a running sum
    in range buckets, so a document may have any number of pages; a long page is
    cut over chunks. Null texts are empty; a document whose text is empty has one
    empty chunk."""
    rows = pages.select("document", "page", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("len", F.length("text").cast("long")).withColumn("one", F.lit(1))
    placed = prefix.running(
        rows, {"upto": ("sum", "len"), "nth": ("count", "one")}, ["page", "text"], group_by=["document"], keep_null_rows=False, **kw
    )
    before = F.when(F.col("nth") > 1, F.lit("\n\n")).otherwise("")
    at = F.col("upto") - F.col("len") + 2 * F.greatest(F.col("nth") - 2, F.lit(0))
    own = placed.select("document", at.alias("at"), F.concat(before, "text").alias("own"))
    last = F.floor((F.col("at") + F.greatest(F.length("own"), F.lit(1)) - 1) / chunk_chars)
    cut = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / chunk_chars), last)))
    low = F.greatest(F.col("chunk") * chunk_chars, F.col("at"))
    size = F.least((F.col("chunk") + 1) * chunk_chars, F.col("at") + F.length("own")) - low
    part = F.substring("own", (low - F.col("at") + 1).cast("int"), size.cast("int"))
    parts = cut.groupBy("document", "chunk").agg(F.sort_array(F.collect_list(F.struct(low.alias("at"), part.alias("part")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "")
    return parts.select("document", "chunk", (F.col("chunk") * chunk_chars).alias("start"), text.alias("text")).where(
        (F.col("text") != "") | (F.col("chunk") == 0)
    )


def ingest_documents(catalog, pages: DataFrame, name: str) -> DataFrame:
    """Store ``<name>_text``, ``_sections``, ``_figures``, ``_document`` and
    ``_metadata`` through the catalog (stage tables in the shared folder) and
    return (table_name, rows) of what was written. Sections, figures and the
    summary are computed from the stored page table, not from the source."""
    text = catalog.store(pages, f"{name}_text")
    secs = catalog.store(sections(text), f"{name}_sections")
    figs = catalog.store(figures(text), f"{name}_figures")
    doc = catalog.store(document_summary(text, secs, figs), f"{name}_document")
    counts = [(t, d.count()) for t, d in [(f"{name}_text", text), (f"{name}_sections", secs), (f"{name}_figures", figs), (f"{name}_document", doc)]]
    spark = pages.sparkSession
    meta = spark.createDataFrame([(name, "documents", *[c for _, c in counts])], "table_name string, source_type string, pages long, sections long, figures long, documents long")
    catalog.store(meta, f"{name}_metadata")
    counts.append((f"{name}_metadata", 1))
    return spark.createDataFrame(counts, "table_name string, rows long").select("table_name", F.col("rows"))
