"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` names the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import lines, packing, simhash, substring, toxicity
from sparkwright.llm.common import table
from sparkwright.session import stage_path


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an operator that rewrites texts, as documents again; n_chars
    follows the text where words or lines went."""
    values = {c: F.col(f"doc.`{c}`") for c in columns if c != "text"}
    values["text"] = F.col("text")
    if "n_chars" in values:
        length = F.length("text").cast("long")
        values["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(values["n_chars"])
    return found.select(*[values[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the rejecting one."""
    rated = toxicity.rate(docs, table(spark, sf_dir, "labels"))
    return rated.where("not rejected").select("doc.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sources."""
    return _with_text(lines.remove_boilerplate(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash."""
    return simhash.keep_one_row(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand a second time in the corpus."""
    return _with_text(substring.dedup(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: SQL cannot express the trained model and the tokenizer of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between them the documents
    are a table in the shared folder that ``spark.checkpoint.dir`` names."""
    docs = table(spark, sf_dir, "documents")
    folder = stage_path(spark, f"corpus-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
