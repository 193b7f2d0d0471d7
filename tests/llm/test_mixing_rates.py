"""Sources that need many repetitions reach their targets."""

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing


def test_large_rates(spark):
    rows = [(k, "x" * 1000, "big") for k in range(200)] + [(1000 + k, "y" * 10, "small") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, weights={"big": 0.9, "small": 0.1})
    got = {r["source"]: r for r in found.groupBy("source").agg(F.sum(F.length("text")).alias("size"), F.min("mix_rate").alias("rate"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("mix_copies").alias("numbers")).collect()}
    rate = 0.1 * 200_200 / 200
    assert got["small"]["rate"] == pytest.approx(rate) and got["small"]["docs"] == 20
    # 20 draws of rate 100.1: a standard deviation of 45 in 2,002 copies
    assert abs(got["small"]["size"] / 10 - 20 * rate) < 5 * (20 * rate) ** 0.5 and got["small"]["numbers"] > 5


@pytest.mark.parametrize("rate", [50.0, 51.0, 130.0, 1500.0])
def test_draws_follow_the_law(spark, rate):
    n = 2000
    r = spark.range(n).select(mixing.copies(F.lit(rate), "t", F.col("id").cast("string")).alias("k")).agg(F.avg("k").alias("mean"), F.var_samp("k").alias("var")).first()
    assert abs(r["mean"] - rate) < 5 * (rate / n) ** 0.5 and r["var"] == pytest.approx(rate, rel=0.2)
