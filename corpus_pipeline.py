"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` lands every stage's result as
Parquet in the shared work folder and reads it back as the next stage's documents. All stages but
the last return the columns of documents; the last returns the packed pieces.

``n_chars`` follows the text where a stage changes it. Edge cases are those of the operators: null
and letter-less texts leave at the first stage, rows of one doc_id are one document and stay or leave together at the
third, empty tables pass through, extra columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edit_signals.llm import decontam, langid, linededup, packing, simhash
from edit_signals.llm.common import land, prepare, table
from edit_signals.llm.queries import vocabulary

#: A trained classifier and vocabulary lookups are beyond SQL; tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a tellable language go."""
    return langid.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more found in 5 documents or more stay in one of them."""
    kept = linededup.drop_lines(docs, min_chars=40, min_docs=5)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3 words, 2 bits) stays."""
    return simhash.keep_one(docs, words=3, bits=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a benchmark item leaked into go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their place in the packed sequences."""
    return packing.pack_documents(docs, vocabulary(), size=2048, end_id=0)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
