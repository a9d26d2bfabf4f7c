"""Text rules on columns: question intent, SQL extraction, markdown clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The intent rules must equal the reference's keyword lists and
# their order (first match wins). "phrases" match as substrings of the
# lower-cased text, "words" as whole tokens of [a-z_]+.
INTENT_RULES = [
    ("insights", ["summarize", "summarise", "conclusion", "key takeaway", "takeaways"], []),
    ("ingestion", ["read file", "open file"], ["upload", "import", "load", "ingest"]),
    ("etl", ["remove duplicate", "fix data"], ["clean", "etl", "transform"]),
    ("visualization", ["show me"], ["chart", "plot", "graph", "visualize", "dashboard"]),
    ("insights", ["why did", "what caused"], ["insight", "trend", "pattern", "analyze", "analyse"]),
    ("report", [], ["report", "summary", "executive"]),
    ("sql", ["group by"], ["sql", "query", "select", "count", "sum", "average"]),
]
DEFAULT_INTENT = "analytics"


def question_words(q: Column) -> Column:
    """Whole-word tokens ``[a-z_]+`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(q), F.lit(r"\b([a-z_]+)\b"), 1)


def intent(question: str | Column) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    low = F.lower(q)
    words = question_words(q)
    out = None
    for label, phrases, toks in INTENT_RULES:
        cond = F.lit(False)
        for p in phrases:
            cond = cond | low.contains(p)
        if toks:
            cond = cond | F.arrays_overlap(words, F.array(*[F.lit(t) for t in toks]))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(DEFAULT_INTENT))


# The next three functions must find what the reference's patterns
# find (fenced blocks, the first select, think blocks), so the patterns are the same.
def extract_select(text: str | Column) -> Column:
    """First ``select ...`` up to ``;`` or the end, preferring a fenced sql block; else null."""
    t = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(t, r"(?is)```sql\s*(.*?)```", 1)
    has_fence = t.rlike(r"(?is)```sql\s*(.*?)```")
    candidate = F.when(has_fence, F.trim(fenced)).otherwise(F.trim(t))
    m = F.regexp_extract(candidate, r"(?is)(\bselect\b[\s\S]*?(?:;|$))", 1)
    sql = F.trim(m)
    return F.when((sql != "") & F.lower(sql).startswith("select"), sql)


def strip_code_blocks(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, r"(?is)```sql\s*.*?```", "")
    t = F.regexp_replace(t, r"(?s)```\s*.*?```", "")
    return strip_ws(t)


# ASCII whitespace (the \s class of Java regex and RE2)
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(c: str | Column) -> Column:
    """``str.strip()`` on ASCII whitespace: tabs and newlines too, not only blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(WHITESPACE))


#: White space of any script, as ``str.strip()`` takes it.
UNICODE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_unicode(c: str | Column) -> Column:
    """``str.strip()``: white space of any script, and the ASCII separators. Both
    ends are read character by character, so inner runs cost nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(UNICODE_SPACE))


def truncate(c: str | Column, n: int = 200) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def model_json_body(c: str | Column) -> Column:
    """Drop <think> blocks and json fences before parsing a model reply."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"```json\s*", "")
    c = F.regexp_replace(c, r"\s*```", "")
    return strip_ws(c)


def first_lines(c: str | Column, n: int = 5) -> Column:
    """Lines that are not blank and do not start with '#', first ``n`` (kept as written)."""
    c = F.col(c) if isinstance(c, str) else c
    keep = F.filter(F.split(c, "\n"), lambda x: (strip_ws(x) != "") & ~x.startswith("#"))
    return F.slice(keep, 1, n)
