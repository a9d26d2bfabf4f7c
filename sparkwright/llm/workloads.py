"""The registered queries of this subpackage (``opN_<name>`` and the pipeline)
with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, embeddings, fingerprints, lines, packing, quality, rules, simhash, substring, token_output,
    toxicity, vector_codes,
)
from .common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.vec_id, (SELECT count(*) FROM link l WHERE l.a = c.vec_id) AS n_links, c.component_id,
       c.vec_id = c.component_id AS kept
FROM comp c
"""


@query("op10_embedding_dedup", EMBEDDINGS_SQL)
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("component", "component_id")


SUBSTRING_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM place WHERE i + 34 <= len(w)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM twice
), kept AS (
  SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t FROM place p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY p.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


RULES_COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def _rules_sql() -> str:
    """The counts, then the determinant estimate step by step: medians and least
    deviations first, five times the closest half of each (lang, source)."""
    names, floors = ["len", "sym", "dup", "rep", "size"], [0.15, 0.35, 1.0, 1.0, 1.5]
    factor = 1.9122080585129484  # share over chi-square mass: 0.5 / F7(F5^-1(0.5))
    p = range(5)
    group = "lang IS NOT DISTINCT FROM e_lang AND source IS NOT DISTINCT FROM e_source"
    y = [" + ".join(f"w_{i}{j} * (x_{names[j]} - m_{j})" for j in range(i + 1)) for i in p]
    far = " + ".join(f"({t}) * ({t})" for t in y)
    steps = []
    for k in range(5):
        sums = ", ".join([f"sum(x_{names[i]}) AS s_{i}" for i in p] + [f"sum(x_{names[i]} * x_{names[j]}) AS q_{i}{j}" for i in p for j in range(i + 1)])
        steps.append(f"""near{k} AS (
  SELECT f.*, floor(16 * log2(1 + {far})) AS bin FROM fit f JOIN e{k} ON {group}
), sub{k} AS (
  SELECT * FROM near{k} QUALIFY count(*) OVER (PARTITION BY lang, source ORDER BY bin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY lang, source, bin) < ceil(0.5 * count(*) OVER (PARTITION BY lang, source))
), sum{k} AS (
  SELECT lang AS e_lang, source AS e_source, count(*) AS n, {sums} FROM sub{k} GROUP BY lang, source
)""")
        cov = ", ".join(
            f"{factor} * (q_{i}{j} / n - (s_{i} / n) * (s_{j} / n))" + (f" + pow({floors[i]} * 1024, 2)" if i == j else "") + f" AS c_{i}{j}"
            for i in p for j in range(i + 1)
        )
        means = ", ".join(f"s_{i} / n AS m_{i}" for i in p)
        steps.append(f"c{k} AS (SELECT e_lang, e_source, {means}, {cov} FROM sum{k})")
        last = f"c{k}"
        for i in p:  # Cholesky factor, one entry after the other
            for j in range(i + 1):
                rest = f"c_{i}{j}" + "".join(f" - l_{i}{t} * l_{j}{t}" for t in range(j))
                steps.append(f"l{k}_{i}{j} AS (SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l_{j}{j}'} AS l_{i}{j} FROM {last})")
                last = f"l{k}_{i}{j}"
        for j in p:  # and its inverse
            for i in range(j, 5):
                total = " ".join(f"- l_{i}{t} * w_{t}{j}" for t in range(j, i))
                steps.append(f"w{k}_{i}{j} AS (SELECT *, {f'1 / l_{i}{i}' if i == j else f'(0.0 {total}) / l_{i}{i}'} AS w_{i}{j} FROM {last})")
                last = f"w{k}_{i}{j}"
        steps.append(f"e{k + 1} AS (SELECT * FROM {last})")
    start = ", ".join(f"median(x_{n}) AS m_{i}" for i, n in enumerate(names))
    start += ", " + ", ".join(f"{1 / (floors[i] * 1024) if i == j else 0.0!r} AS w_{i}{j}" for i in p for j in range(i + 1))
    return rf"""
WITH doc AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc
), gram AS (
  SELECT doc_id, i FROM place WHERE i + 4 <= len(w) QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 4], ' ')) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM gram) g GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM doc d LEFT JOIN rep r ON d.doc_id = r.doc_id
), stat AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CAST(round(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * 1024) AS BIGINT) AS x_len,
    CAST(round(ln(1 + 100 * n_symbols / greatest(word_chars, 1)) * 1024) AS BIGINT) AS x_sym,
    CAST(round(ln(1 + n_dup_lines) * 1024) AS BIGINT) AS x_dup,
    CAST(round(ln(1 + 100 * n_repeat_words / greatest(n_words, 1)) * 1024) AS BIGINT) AS x_rep,
    CAST(round(ln(greatest(n_words, 1)) * 1024) AS BIGINT) AS x_size
  FROM counted
), fit AS (
  SELECT * FROM stat WHERE NOT base_failed
), e0 AS (
  SELECT lang AS e_lang, source AS e_source, {start} FROM fit GROUP BY lang, source
), {", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({far} <= 31.0, false) AS kept
FROM stat LEFT JOIN e5 ON {group}
"""


@query("op7_quality_rules", _rules_sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select(*RULES_COLUMNS)


# 10: lines.MIN_SITES, stated apart from the code it checks.
LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), worded AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM line
), boiler AS (
  SELECT body, min({'d': doc_id, 'p': pos}) AS first FROM worded WHERE body <> ''
  GROUP BY body HAVING count(DISTINCT source) >= 10
), judged AS (
  SELECT w.doc_id, w.pos, w.line, b.body IS NOT NULL AND {'d': w.doc_id, 'p': w.pos} <> b.first AS gone
  FROM worded w LEFT JOIN boiler b ON w.body = b.body
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM judged GROUP BY doc_id
"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.rate(docs, table(spark, sf_dir, "labels"))
    return rated.select("doc.doc_id", "severity", "grade", "rejected")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_output")
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _vector_codes_sql() -> str:
    """Four rounds of assigning and moving, then the last assignment; a cell is
    one component of one part, entries and parts in long form."""
    nearest = """near{k} AS (
  SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
    FROM cell c JOIN book{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY c.rid, c.part, b.entry
  ) far GROUP BY rid, part
)"""
    moved = """mean{k} AS (
  SELECT n.part, n.entry, c.pos, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x
  FROM near{k} n JOIN cell c ON c.rid = n.rid AND c.part = n.part GROUP BY n.part, n.entry, c.pos
), book{next} AS (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
)"""
    steps = [", ".join(t.format(k=k, next=k + 1) for t in (nearest, moved)) for k in range(4)] + [nearest.format(k=4)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (
  SELECT rid, len(embedding) // 4 AS width, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS spot FROM kept
), cell AS MATERIALIZED (
  SELECT rid, spot // width AS part, spot % width AS pos, CAST(floor(v::DOUBLE * 1024) AS BIGINT) AS x FROM long
), book0 AS (
  SELECT part, rid AS entry, pos, x FROM cell WHERE rid < 256
), {", ".join(steps)}, row_error AS (
  SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near4 GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book4
)
SELECT k.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept k JOIN row_error e ON k.rid = e.rid, digest
"""


@query("op13_vector_codes", _vector_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS p, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece
), place AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), gram AS (
  SELECT lang, w[i : i + k] AS g FROM place, range(4) AS size(k) WHERE i + k <= len(w)
), f AS MATERIALIZED (
  SELECT lang, g, count(*) AS a FROM gram GROUP BY lang, g HAVING count(*) >= 30
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), part AS (
  SELECT f.lang, f.g[s + 1 : s + m] AS g, max(f.a) AS longer
  FROM f, range(2, 4) AS length(m), range(3) AS start(s) WHERE m < len(f.g) AND s + m <= len(f.g) GROUP BY f.lang, f.g[s + 1 : s + m]
), kept AS (
  SELECT f.lang, f.g, f.a FROM f LEFT JOIN part ON f.lang = part.lang AND f.g = part.g
  WHERE len(f.g) > 1 AND (part.longer IS NULL OR 100 * part.longer < 80 * f.a)
), rated AS (
  SELECT k.lang, k.g, k.a, c.k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * k.a // (x.a + y.a) AS BIGINT) AS score
  FROM kept k JOIN range(1, 4) AS c(k) ON c.k < len(k.g)
  JOIN f x ON x.lang = k.lang AND x.g = k.g[1 : c.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[c.k + 1 : len(k.g)]
), best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM rated
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN total t ON b.lang = t.lang
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
