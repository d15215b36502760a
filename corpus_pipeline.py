"""A training corpus from raw documents: language, lines, near-duplicates, mixture, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, other columns go.

Nulls and odd inputs: texts that are null, empty or without a letter go in the first stage; later stages
take a null text as an empty one and keep rows with a null id; rows that repeat an id and text are one
document to the line and near-duplicate stages, whose decisions hold for all of them; an empty table
gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import materialize, read_table, release, scratch_scope
from glossa.llm.language import keep_known_languages
from glossa.llm.line_dedup import dedup_lines
from glossa.llm.mix_sources import mix_documents
from glossa.llm.near_dedup import drop_near_duplicates
from glossa.llm.pack import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or are less similar to every language than the labelled texts of their size are to theirs."""
    return keep_known_languages(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them."""
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: rows are left out, taken, or taken twice."""
    return mix_documents(docs.select(*COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in packed sequences."""
    return pack_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: Language profiles, sketches, and tokens can't be expressed in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables go when its result is written, and its input when the next one's is."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope():
            done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", scoped=False)
        release(docs)
        docs = done
    return docs
