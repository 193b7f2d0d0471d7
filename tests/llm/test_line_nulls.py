"""Null and repeated ids of the line operator, both joins of digests, against its SQL."""

import duckdb
import pytest

from gleanery.llm import lines, queries


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_null_and_repeated_ids(spark, tmp_path, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)  # 3: most digests are light, and take the join
    long = "one two three four five six seven eight nine. "
    texts = [(None, long), (None, long), (None, long), (3, "Other.\nyes.\n"), (None, "yes.\n"), (5, long + long), (5, long + long), (6, ""), (7, None), (None, "no.\n"), (None, "No.")]
    texts += [(100 + k, f"line {k}.\nline {k + 1}.\n") for k in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op3_lines(spark, str(tmp_path))
    run = c.execute(queries.OP3_SQL)
    names = [d[0] for d in run.description]
    want = sorted(repr(tuple(r[names.index(x)] for x in df.columns)) for r in run.fetchall())
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == want and sum(g.startswith("(None") for g in got) == 5
