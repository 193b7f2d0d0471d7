"""Top-k on integers beyond 64 bits, ties included, against Python's integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import topk


def brute(rows, k):
    whole = {i: [math.floor(64 * Fraction(c)) for c in v] for i, v in rows}
    out = set()
    for q, x in whole.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in whole.items() if i != q)[:k]
            out |= {(q, n, i, str(-s)) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("scales", [(1.0,), (1.0, 4e8), (1e-3, 1e10, 3e38), (1e-3, 1e160, 1e308)])
def test_any_size(spark, scales):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice(scales)).tolist()) for i in range(90)]
    rows = [(i, [max(-1.7e308, min(1.7e308, c)) for c in v]) for i, v in rows] + [(91, rows[1][1]), (100, [scales[-1], 1.0]), (101, []), (120, rows[0][1]), (140, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.pmod(F.col("id"), F.lit(20)) == 0, 7).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["digits"]) for r in got} == brute(rows, 7) and len(got) == len(brute(rows, 7))
    assert all(r["score"] == (int(r["digits"]) if abs(int(r["digits"])) < 2**63 else None) for r in got)


def test_keys_are_in_order():
    numbers = sorted({s * (10**n + d) for n in range(0, 120, 7) for d in (-1, 0, 1) for s in (-1, 1)})
    keys = [topk.key(n) for n in numbers]
    assert keys == sorted(keys)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(20 * i if i < 60 else 20 * i + 1, rng.normal(size=5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.pmod(F.col("id"), F.lit(20)) == 0, 9).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["digits"]) for r in got} == brute(rows, 9)
