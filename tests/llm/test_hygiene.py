"""Media that can't be read, intermediate tables that go, and shared folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import common, media


def test_clips_of_bad_files(spark):
    good = media.encode(np.frombuffer(b"abc" * 500, np.uint8), np.array([0, 1500]))[0]
    frame = media.jpeg_header()
    other = good.replace(frame, frame.replace((media.ROWS * 8).to_bytes(2, "big") + (media.COLS * 8).to_bytes(2, "big"), (media.ROWS * 4).to_bytes(2, "big") + (media.COLS * 16).to_bytes(2, "big")))
    rows = [(1, good), (2, b""), (3, b"RIFF"), (4, good[:-700]), (5, None), (6, other), (None, good)]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in rows], "id long, media binary").coalesce(1)
    got = media.clips(df.withColumn("error", F.lit("x"))).collect()
    ok = {i: sum(r["n_frames"] for r in got if r["id"] == i and r["error"] is None) for i in (1, None)}
    assert ok == {1: 8, None: 8} and {2, 3} <= {r["id"] for r in got if r["error"]} and 5 not in {r["id"] for r in got}
    assert {1, 2, 3, 4, 6, None} == {r["id"] for r in got} and all((r["clip"] is None) == (r["error"] is not None) for r in got)


def test_stage_tables_go(spark, sf_dir):
    folder = f"{common.shared_dir(spark)}/gleanery"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    done = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("mixing-") and done.count() > 0


def test_no_private_folder_off_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
