"""Repeated lines of short sentences, and of languages without blanks, against brute force over whole lines."""

import re

from gleanery.llm import lines, queries

TEXTS = [
    "Yes. No. Pi is 3.14 or so, e.g. here.\nOnly here. Once.\n",
    "First of all.\nyes.  No. pi is 3.14 or so, e.g. here.\n去年今日此门中，人面桃花相映红。\n",
    "去年今日此门中，人面桃花相映红。\n\nYes. No.\nA sentence of as many as nine words, and more. Short.\n",
    "A sentence of as many as nine words, and more. Other.\nFoo\n![image](a.png)\nYes. No. Pi is 3.14 or so, e.g. here.",
    "Foo\nYes.\nA sentence of as many as nine words, and more. Short.\nFoo\n",
]


def removed(rows):
    out = {i: list(t) for i, t in enumerate(TEXTS)}
    for r in rows:
        out[r["doc_id"]][r["start"] : r["end"]] = [""] * (r["end"] - r["start"])
    return {i: "".join(t) for i, t in out.items()}


def test_repeated_lines_go(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op3_lines(spark, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
    left = removed(rows)
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        want[i] = ""
        for m in re.finditer(r"[^\n]*\n+|[^\n]+", t):
            key = tuple(m[0].lower().split())
            want[i] += "" if key and key in seen else m[0]
            seen.add(key)
    # the long sentence goes by itself as well
    want[3] = want[3].replace("A sentence of as many as nine words, and more.", "")
    assert left == want
    same = {(r["doc_id"], r["unit"]): r for r in rows}
    kept = {(r["doc_id"], r["unit"], r["start"]) for r in lines.units(docs, lines.WITHIN_LINES, whole_lines=True).collect()} - {(r["doc_id"], r["unit"], r["start"]) for r in rows}
    assert all((r["keep_doc_id"], r["keep_unit"]) not in same for r in rows) and {(r["keep_doc_id"], r["keep_unit"]) for r in rows} <= {k[:2] for k in kept}


def test_long_units_as_before(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    floor = {tuple(r) for r in lines.repeated_units(docs).collect()}
    assert floor and floor < {tuple(r) for r in queries.op3_lines(spark, sf_dir).collect()}
