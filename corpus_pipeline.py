"""A pipeline from raw documents to token ids: each stage works on all that the one before it kept.

1. toxicity: documents that the learnt grammar scores 0.7 or more go.
2. near_dedup: of each component of near duplicates (shingles of five words, similarity 0.8) the least doc_id stays.
3. suffix_dedup: every byte under a string of 100 bytes that also starts earlier goes; n_chars follows the text.
4. mixing: sources are repeated a Poisson number of times towards shares of the square root of their sizes.
5. pieces: texts are encoded; rows are (doc_id, source, n_tokens, ids).

Rows with null ids or texts pass through every stage (a null text is like an empty one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import mixing, neardup, pieces, suffix, toxicity
from gleanery.llm.common import as_table, drop_tables, n_tables
from gleanery.llm.queries import piece_model, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), F.lit(False), threshold=0.7)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, size=5, percent=80)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, temperature=0.5, budget=1.0)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(docs, piece_model()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("suffix_dedup", _suffix_dedup), ("mixing", _mixing), ("pieces", _pieces)]

#: Learning, hashing into sketches and byte-level encoding are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        start = n_tables()
        docs = as_table(stage(spark, docs, sf_dir), name)
        drop_tables(spark, start - (k > 0), n_tables() - 1)  # what the stage read and made on its way
    return STAGES[-1][1](spark, docs, sf_dir)
