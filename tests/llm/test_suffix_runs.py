"""Packed runs, their hashes, and a minimizer with very many different surroundings."""

import random

import numpy as np
import pyarrow as pa

from gleanery.llm import suffix
from test_operators import brute_suffix


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        found = np.zeros(n, suffix._RUN)
        found["fp"] = rng.integers(0, 2**48, n)
        for k in ("sh", "s2"):
            found[k] = rng.integers(0, 2**64, n, dtype=np.uint64)
        found["doc"], found["s0"], found["n"] = rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**31 - 1, n), rng.integers(1, 78, n)
        blob = suffix._pack(found)
        back = suffix._unpack(blob)
        order = lambda x: x[np.lexsort((x["s0"], x["doc"]))]
        assert len(blob) == n * suffix._WIDTH and (order(back) == order(found)).all()


def test_either_hash_tells_runs_apart():
    found = np.zeros(3, suffix._RUN)
    found["doc"] = [1, 2, 3]
    found["s2"] = [0, 0, 1]
    first, later = suffix.summed(found)
    assert first["doc"].tolist() == [1, 3] and later["doc"].tolist() == [2]
    text = np.random.default_rng(5).integers(97, 123, 900).astype(np.uint8)
    a, b = suffix.runs(text, np.array([0, len(text)]), np.array([1])), suffix.runs(text[5:], np.array([0, len(text) - 5]), np.array([2]))
    assert {(r["fp"], r["sh"], r["s2"]) for r in a[-2:]} == {(r["fp"], r["sh"], r["s2"]) for r in b[-2:]}


def test_one_minimizer_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 8)
    rng = random.Random(4)
    core = "common passage of forty bytes or so, here."
    rows = [(k, "".join(rng.choices("abcdefgh", k=70)) + core + "".join(rng.choices("abcdefgh", k=70))) for k in range(400)]
    rows += [(1000 + k, rows[k][1][: 90 + k] + rows[k + 1][1][60:]) for k in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: tuple(v[:4]) for i, v in brute_suffix(dict(rows)).items()}
    assert got == want and sum(v[1] > 0 for v in got.values()) > 30


def test_marks_split_a_minimizer_everywhere(monkeypatch):
    """What one task splits, the bucket splits for the runs of other tasks."""
    monkeypatch.setattr(suffix, "SPLIT", 3)
    found = np.zeros(9, suffix._RUN)
    found["fp"], found["sh"], found["doc"], found["n"] = [5] * 6 + [6] * 3, range(9), range(9), 10
    one = list(suffix._dealt(found, 4))
    other = found[[0, 6]].copy()
    other["doc"], other["sh"] = [20, 21], [50, 51]
    two = list(suffix._dealt(other, 4))
    rows = [r for b in one + two for r in b.to_pylist()]
    assert sorted(r["doc"] for r in rows if r["kind"] == suffix.WINDOWS) == list(range(6))
    rows.sort(key=lambda r: r["bucket"])
    met = [r for b in suffix._met(iter([pa.RecordBatch.from_pylist(rows, one[0].schema)])) for r in b.to_pylist()]
    assert sorted((r["kind"], r["doc"]) for r in met) == [(1, 6), (1, 7), (1, 8), (1, 21), *((2, d) for d in [*range(6), 20])]
