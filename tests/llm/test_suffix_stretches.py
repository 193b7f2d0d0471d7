"""A text longer than positions have bits for."""

import numpy as np

from gleanery.llm import suffix


def windows(found):
    return sorted((int(r["doc"]), int(r["s0"]) + k, int(r["fp"])) for r in found for k in range(r["n"]))


def test_runs_of_long_texts(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 12_000, dtype=np.uint8)
    off, docs = np.array([0, 9_000, 9_050, 12_000]), np.array([7, 8, 9])
    want = windows(suffix.runs(data, off, docs))
    assert [w[:2] for w in want] == [(7, k) for k in range(8_901)] + [(9, k) for k in range(2_851)]
    monkeypatch.setattr(suffix, "_POS", np.uint64((1 << 12) - 1))
    assert windows(suffix.runs(data, off, docs)) == want
