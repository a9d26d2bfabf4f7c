"""D01-D14 document-text and chat-text workloads.

Documents: ``source`` is the document and ``doc_id`` the page. Chat rules need
questions / replies that use the keywords; they are derived from every
conversation row by prefixing a template chosen by ``turn``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.topk import top_k_per_group
from ..plans import docs as DOC
from . import register, table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return DOC.page_text(d, "source", "doc_id", "text")


PAGES_SQL = f"""
SELECT source AS document, doc_id AS page, {_strip('text')} AS text, length({_strip('text')}) AS char_count, 'embedded' AS source
FROM documents WHERE {_strip('text')} <> ''
"""


@register("doc_page_text", f"SELECT document, page, char_count, source, md5(text) AS text_md5 FROM ({PAGES_SQL}) p")
def doc_page_text(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("document", "page", "char_count", "source", F.md5("text").alias("text_md5"))


@register(
    "doc_is_scanned",
    f"""SELECT source AS document, count(*) AS pages, CAST(sum(CASE WHEN length({_strip('text')}) < 50 THEN 1 ELSE 0 END) AS BIGINT) AS short_pages,
sum(CASE WHEN length({_strip('text')}) < 50 THEN 1 ELSE 0 END) / count(*) > 0.5 AS is_scanned FROM documents GROUP BY source""",
)
def doc_is_scanned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), "text")
    return DOC.scanned_documents(d)


@register(
    "doc_text_fallback",
    f"""
WITH e AS (SELECT source AS document, doc_id AS page, {_strip('text')} AS t FROM documents WHERE lang IN ('en', 'fr')),
o AS (SELECT source AS document, doc_id AS page, {_strip("split_part(text, chr(10), 1)")} AS t FROM documents),
j AS (SELECT s.source AS document, s.doc_id AS page, e.t AS et, o.t AS ot FROM documents s
      LEFT JOIN e ON e.document = s.source AND e.page = s.doc_id LEFT JOIN o ON o.document = s.source AND o.page = s.doc_id)
SELECT document, page,
       md5(CASE WHEN length(et) >= 50 THEN et WHEN ot <> '' THEN ot ELSE '' END) AS text_md5,
       length(CASE WHEN length(et) >= 50 THEN et WHEN ot <> '' THEN ot ELSE '' END) AS char_count,
       CASE WHEN length(et) >= 50 THEN 'embedded' WHEN ot <> '' THEN 'ocr' ELSE 'empty' END AS source
FROM j
""",
)
def doc_text_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    spine = d.select(F.col("source").alias("document"), F.col("doc_id").alias("page"))
    emb = d.where(F.col("lang").isin("en", "fr")).select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")
    ocr = d.select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.split("text", "\n")[0].alias("text"))
    out = DOC.text_with_fallback(spine, emb, ocr)
    return out.select("document", "page", F.md5("text").alias("text_md5"), "char_count", "source")


def _lines_sql() -> str:
    return f"""
WITH p AS ({PAGES_SQL}),
l0 AS (SELECT document, page, unnest(generate_series(0, len(parts) - 1)) AS pos, unnest(parts) AS raw
       FROM (SELECT document, page, string_split(text, chr(10)) AS parts FROM p) x),
l AS (SELECT document, page, pos, {_strip('raw')} AS line FROM l0 WHERE {_strip('raw')} <> ''),
h AS (SELECT *, length(line) < 120 AND (regexp_matches(line, '^[0-9]+[.]?\\s+') OR regexp_matches(line, '^[A-Z][A-Z\\s][A-Z\\s][A-Z\\s]')
        OR regexp_matches(line, '^Chapter\\s+[0-9]') OR regexp_matches(line, '^Section\\s+[0-9]')) AS is_heading FROM l)"""


@register(
    "doc_sections",
    _lines_sql()
    + """,
s AS (SELECT *, CAST(sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY document, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS section_no FROM h),
g AS (SELECT document, page, section_no, max(CASE WHEN is_heading THEN line END) AS heading,
             string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY pos) AS body,
             count(*) FILTER (WHERE NOT is_heading) AS n FROM s GROUP BY document, page, section_no)
SELECT document, page, section_no, coalesce(heading, '') AS heading, md5(body) AS text_md5, length(body) AS text_chars FROM g WHERE n > 0
""",
)
def doc_sections(spark, sf_dir):
    s = DOC.sections(_pages(spark, sf_dir))
    return s.select("document", "page", "section_no", "heading", F.md5("text").alias("text_md5"), F.length("text").alias("text_chars"))


@register("doc_headings", _lines_sql() + " SELECT document, page, pos, line AS heading FROM h WHERE is_heading")
def doc_headings(spark, sf_dir):
    return DOC.headings(_pages(spark, sf_dir)).select("document", "page", F.col("pos").cast("bigint").alias("pos"), "heading")


def _figures_sql() -> str:
    # label, optional separator and currency, number, optional unit; stated here
    # apart from the code it checks
    pat = (
        r"(?i)([A-Za-z][A-Za-z\s&/''-]{2,60}?)\s*[:\-]?\s*(?:Rs\.?|₹|\$|EUR|GBP)?\s*"
        r"([\d,]+(?:\.\d+)?)\s*(crores?|lakhs?|millions?|billions?|mn|bn|cr)?"
    )
    return f"""
WITH p AS ({PAGES_SQL}),
m AS (SELECT document, page, regexp_extract_all(text, '{pat}', 1) AS l, regexp_extract_all(text, '{pat}', 2) AS v,
             regexp_extract_all(text, '{pat}', 3) AS u FROM p),
x AS (SELECT document, page, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS label0, unnest(v) AS value0, unnest(u) AS unit0 FROM m),
y AS (SELECT document, page, pos, {_strip('label0')} AS label, TRY_CAST(replace(value0, ',', '') AS DOUBLE) AS value,
             lower(coalesce(unit0, '')) AS unit FROM x),
z AS (SELECT * FROM y WHERE value IS NOT NULL AND value <> 0 AND length(label) >= 3)
SELECT document, arg_min(page, (page, pos)) AS page, label, value, arg_min(unit, (page, pos)) AS unit FROM z GROUP BY document, label, value
"""


@register("doc_figures", _figures_sql())
def doc_figures(spark, sf_dir):
    return DOC.figures(_pages(spark, sf_dir))


@register(
    "doc_summary",
    _lines_sql()
    + f""",
s AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY document, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no FROM h),
sec AS (SELECT document, count(*) AS n FROM (SELECT document, page, section_no FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_heading) > 0) t GROUP BY document),
fig AS (SELECT document, count(*) AS n FROM ({_figures_sql()}) f GROUP BY document),
base AS (SELECT document, count(*) AS total_pages, count(*) FILTER (WHERE char_count > 0) AS pages_with_text,
                CAST(sum(char_count) + 2 * (count(*) - 1) AS BIGINT) AS full_text_chars FROM p GROUP BY document)
SELECT base.document, total_pages, pages_with_text, coalesce(sec.n, 0) AS sections_found, coalesce(fig.n, 0) AS figures_found, full_text_chars
FROM base LEFT JOIN sec USING (document) LEFT JOIN fig USING (document)
""",
)
def doc_summary(spark, sf_dir):
    return DOC.document_summary(_pages(spark, sf_dir))


@register(
    "doc_full_text",
    f"""
WITH p AS ({PAGES_SQL}),
whole AS (SELECT document, string_agg(text, chr(10) || chr(10) ORDER BY page) AS t FROM p GROUP BY document),
c AS (SELECT document, t, unnest(range((length(t) + 9999) // 10000)) AS chunk FROM whole)
SELECT document, chunk, chunk * 10000 AS start, length(substr(t, chunk * 10000 + 1, 10000)) AS chars,
       md5(substr(t, chunk * 10000 + 1, 10000)) AS text_md5 FROM c
""",
)
def doc_full_text(spark, sf_dir):
    c = DOC.full_text(_pages(spark, sf_dir), chunk_chars=10_000)
    return c.select("document", "chunk", "start", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ chat text

_QUESTIONS = [
    "please summarize the key takeaways",
    "read file sales.csv now",
    "can you upload this",
    "remove duplicate rows first",
    "clean the table",
    "show me revenue",
    "plot the numbers",
    "why did profit fall",
    "is there a trend",
    "write an executive report",
    "group by region please",
    "count the orders",
    "hello there",
    "chart the trend and summarize it",
    "load and clean then plot",
]


def _q_sql() -> str:
    arr = "[" + ", ".join(f"'{t}'" for t in _QUESTIONS) + "]"
    return f"{arr}[turn % {len(_QUESTIONS)} + 1] || ' ' || text"


def _q_col():
    arr = F.array(*[F.lit(t) for t in _QUESTIONS])
    return F.concat(F.element_at(arr, (F.col("turn") % len(_QUESTIONS) + 1).cast("int")), F.lit(" "), F.col("text"))


def _intent_sql(qexpr: str) -> str:
    """The first rule that holds; has: text within, word: a whole word."""
    has = lambda *parts: [f"contains(lower({qexpr}), '{x}')" for x in parts]
    word = lambda *parts: [f"regexp_matches(lower({qexpr}), '\\b({'|'.join(parts)})\\b')"]
    rules = [
        ("insights", has("summarize", "summarise", "conclusion", "key takeaway", "takeaways")),
        ("ingestion", has("read file", "open file") + word("upload", "import", "load", "ingest")),
        ("etl", has("remove duplicate", "fix data") + word("clean", "etl", "transform")),
        ("visualization", has("show me") + word("chart", "plot", "graph", "visualize", "dashboard")),
        ("insights", has("why did", "what caused") + word("insight", "trend", "pattern", "analyze", "analyse")),
        ("report", word("report", "summary", "executive")),
        ("sql", has("group by") + word("sql", "query", "select", "count", "sum", "average")),
    ]
    return "CASE " + " ".join(f"WHEN {' OR '.join(c)} THEN '{label}'" for label, c in rules) + " ELSE 'analytics' END"


@register("chat_intent", f"SELECT conv_id, turn, {_intent_sql('q')} AS intent FROM (SELECT conv_id, turn, {_q_sql()} AS q FROM conversations) t")
def chat_intent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TX.intent(_q_col()).alias("intent"))


@register(
    "chat_intent_counts",
    f"SELECT intent, count(*) AS n FROM (SELECT {_intent_sql('q')} AS intent FROM (SELECT {_q_sql()} AS q, turn FROM conversations) t) i GROUP BY intent",
)
def chat_intent_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(TX.intent(_q_col()).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


# replies: fenced sql / inline select / plain text / select to the end, by turn
_REPLY_SQL = """CASE turn % 4
  WHEN 0 THEN 'Here it is:' || chr(10) || '```sql' || chr(10) || 'SELECT conv, count(*) FROM t WHERE turn = ' || CAST(turn AS VARCHAR) || ';' || chr(10) || '```' || chr(10) || text
  WHEN 1 THEN text || ' then select sum(x) from t group by y; done'
  WHEN 2 THEN text
  ELSE 'Select * from conversations where conv_id = ' || CAST(conv_id AS VARCHAR) END"""


def _reply_col():
    t = F.col("turn")
    return (
        F.when(t % 4 == 0, F.concat(F.lit("Here it is:\n```sql\nSELECT conv, count(*) FROM t WHERE turn = "), t.cast("string"), F.lit(";\n```\n"), F.col("text")))
        .when(t % 4 == 1, F.concat(F.col("text"), F.lit(" then select sum(x) from t group by y; done")))
        .when(t % 4 == 2, F.col("text"))
        .otherwise(F.concat(F.lit("Select * from conversations where conv_id = "), F.col("conv_id").cast("string")))
    )


def _extract_sql(x: str) -> str:
    cand = (
        f"CASE WHEN regexp_matches({x}, '(?is)```sql\\s*(.*?)```') THEN {_strip(f'regexp_extract({x}, ' + chr(39) + '(?is)```sql\\s*(.*?)```' + chr(39) + ', 1)')} "
        f"ELSE {_strip(x)} END"
    )
    m = _strip(f"regexp_extract({cand}, '(?is)(\\bselect\\b[\\s\\S]*?(?:;|$))', 1)")
    return f"CASE WHEN {m} <> '' AND starts_with(lower({m}), 'select') THEN {m} END"


@register(
    "chat_extract_sql",
    f"SELECT conv_id, turn, {_extract_sql('r')} AS sql FROM (SELECT conv_id, turn, {_REPLY_SQL} AS r FROM conversations) t",
)
def chat_extract_sql(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TX.extract_select(_reply_col()).alias("sql"))


@register(
    "chat_strip_code",
    f"""SELECT conv_id, turn, md5({_strip("regexp_replace(regexp_replace(r, '(?is)```sql\\s*.*?```', '', 'g'), '(?s)```\\s*.*?```', '', 'g')")}) AS text_md5
FROM (SELECT conv_id, turn, {_REPLY_SQL} AS r FROM conversations) t""",
)
def chat_strip_code(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(TX.strip_code_blocks(_reply_col())).alias("text_md5"))


_JSON_SQL = """CASE turn % 3
  WHEN 0 THEN '<think>' || text || '</think>```json' || chr(10) || '{"answer": ' || CAST(turn AS VARCHAR) || ', "ok": true}' || chr(10) || '```'
  WHEN 1 THEN '{"answer": ' || CAST(conv_id AS VARCHAR) || '}'
  ELSE text END"""


def _json_col():
    t = F.col("turn")
    return (
        F.when(t % 3 == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit('</think>```json\n{"answer": '), t.cast("string"), F.lit(', "ok": true}\n```')))
        .when(t % 3 == 1, F.concat(F.lit('{"answer": '), F.col("conv_id").cast("string"), F.lit("}")))
        .otherwise(F.col("text"))
    )


def _json_body_sql(x: str) -> str:
    b = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g'), '```json\\s*', '', 'g'), '\\s*```', '', 'g')"
    return _strip(b)


@register(
    "chat_parse_json",
    f"""SELECT conv_id, turn, json_valid(b) AS parsed_ok, CASE WHEN json_valid(b) THEN CAST(json_extract(b, '$.answer') AS BIGINT) END AS answer,
CASE WHEN json_valid(b) THEN NULL ELSE left(b, 500) END AS raw
FROM (SELECT conv_id, turn, {_json_body_sql(_JSON_SQL)} AS b FROM conversations) t""",
)
def chat_parse_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    b = TX.model_json_body(_json_col())
    v = F.try_parse_json(b)
    return c.select(
        "conv_id", "turn", v.isNotNull().alias("parsed_ok"),
        F.try_variant_get(v, "$.answer", "bigint").alias("answer"),
        F.when(v.isNull(), F.substring(b, 1, 500)).alias("raw"),
    )


@register(
    "chat_first_lines",
    f"""
WITH x AS (SELECT conv_id, turn, list_filter(string_split('# notes' || chr(10) || text, chr(10)),
                  lambda s: {_strip('s')} <> '' AND NOT starts_with(s, '#'))[1:5] AS ls FROM conversations)
SELECT conv_id, turn, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line FROM x
""",
)
def chat_first_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ls = TX.first_lines(F.concat(F.lit("# notes\n"), F.col("text")))
    return c.select("conv_id", "turn", F.posexplode(ls).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


@register(
    "chat_last_turns",
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
)
def chat_last_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return top_k_per_group(c, ["conv_id"], [F.col("turn").desc()], 20).drop("rank")


@register(
    "expr_truncate",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM documents",
)
def expr_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.truncate("text", 200).alias("text"))


@register(
    "doc_ingest",
    _lines_sql()
    + f""",
s AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY document, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no FROM h),
sec AS (SELECT document, page, section_no FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_heading) > 0),
fig AS ({_figures_sql()})
SELECT 'docs_text' AS table_name, count(*) AS rows FROM p
UNION ALL SELECT 'docs_sections', count(*) FROM sec
UNION ALL SELECT 'docs_figures', count(*) FROM fig
UNION ALL SELECT 'docs_document', count(DISTINCT document) FROM p
UNION ALL SELECT 'docs_metadata', 1
""",
)
def doc_ingest(spark, sf_dir):
    import uuid

    from ..session import stage_path
    from ..sources.catalog import Catalog

    cat = Catalog(spark, root=stage_path(spark, f"docs-{uuid.uuid4().hex[:10]}"))
    return DOC.ingest_documents(cat, _pages(spark, sf_dir), "docs")
