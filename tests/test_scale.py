"""Plans hold what they should: pushed filters, pruned columns, one evaluation a document, no cross joins."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import queries
from gleanery.operators import merge, verdict
from gleanery.operators.evaluate import evaluated
from gleanery.sources.base import raw


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dates_reach_the_scan(spark, tmp_path):
    raw(spark.createDataFrame([("a", "<r/>", datetime(2020, 1, 1))], "identifier string, xml string, datestamp timestamp")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).where(verdict.outdated(F.lit(datetime(2019, 1, 1)), "datestamp"))
    text = plan(evaluated(docs, queries.ORDERS, "s").where("op = 'index'"))
    assert "PushedFilters: [Or(IsNull(datestamp)" in text and text.count("ArrowEvalPython") == 1


def test_columns_are_pruned(spark, sf_dir):
    text = plan(merge.unseen(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "text" not in text


def test_no_cross_joins(spark, sf_dir):
    for name in ("upsert_merge", "delete_unseen_scoped", "crawl_frontier", "latest_wins", "harvest_orders"):
        text = plan(queries.QUERIES[name](spark, sf_dir))
        assert "Cartesian" not in text and "NestedLoop" not in text
