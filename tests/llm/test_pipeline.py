import duckdb
import sentencepiece

import corpus_pipeline as pipeline
from gleanery.llm import queries
from gleanery.llm.common import as_table


def test_stages_by_brute_force(spark, sf_dir):
    """Each stage keeps the columns and does to its input what a plain version does."""
    from test_operators import brute_suffix  # noqa: PLC0415

    docs = queries.table(spark, sf_dir, "documents")
    names, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
        assert docs.columns == names
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert set(after) <= set(before)
        if name in ("toxicity", "near_dedup", "mixing"):
            assert all(after[i] == before[i] for i in after)
        if name == "suffix_dedup":
            want = brute_suffix({i: t or "" for i, t in before.items()})
            for i, t in before.items():
                if want[i][1] == 0:
                    assert after[i] == t
                else:
                    assert abs(len(after.get(i, "").encode()) - len(want[i][4])) <= 6 * want[i][2]
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        seen[name] = len(rows)
        before = after
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == seen["mixing"] and all(r["ids"] == sp.encode(before[r["doc_id"]] or "", add_eos=True) and r["n_tokens"] == len(r["ids"]) for r in last)
    assert 0.5 * seen["suffix_dedup"] < seen["mixing"] < 2 * seen["suffix_dedup"]


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert pipeline.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels"):
        queries.table(spark, sf_dir, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        run = c.execute(sql)
        columns = [d[0] for d in run.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(repr(tuple(r[columns.index(x)] for x in df.columns)) for r in run.fetchall())
        assert sorted(repr(tuple(r)) for r in df.collect()) == want, name
