"""The SQL of the mixing query beyond a rate of 50, and columns with the operator's own names."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import mixing, queries


def test_sql_of_large_rates(spark, tmp_path):
    rows = [(k, "x" * 2_000_000, "en", "big", 1) for k in range(3)] + [(1000 + k, "y" * 3, "en", "tiny", 1) for k in range(12)] + [(None, "z", "en", None, 1), (None, "z", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op7_mixing(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    run = c.execute(queries.OP7_SQL)
    names = [d[0] for d in run.description]
    want = {(r[names.index("doc_id")], r[names.index("mix_copy")], r[names.index("mix_copies")], r[names.index("mix_rate")]) for r in run.fetchall()}
    got = {(r["doc_id"], r["mix_copy"], r["mix_copies"], r["mix_rate"]) for r in df.collect()}
    assert got == want and max(r[3] for r in got) > 1000


def test_clashing_columns(spark):
    clash = ("mix_source", "mix_salt", *mixing.ADDED)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(9).cast("long").alias("n_chars"), *(F.col("id").cast("string").alias(c) for c in clash))
    kept = corpus_pipeline._mixing(spark, docs, None)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert rows and all(r[c] == str(r["doc_id"]) for r in rows for c in clash)
    mixed = mixing.mix(docs)
    assert sorted(mixed.columns) == sorted(docs.columns) and all(r["mix_source"] == str(r["doc_id"]) and r["mix_rate"] == pytest.approx(r["mix_rate"]) for r in mixed.collect())
