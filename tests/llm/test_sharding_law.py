"""Shards against plain longest-processing-time scheduling of every group."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.llm import sharding


@pytest.mark.parametrize("seed", range(30))
def test_histogram_is_the_heap(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 16])
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 50, rng.randrange(1, 1000)]) for _ in range(rng.choice([0, 3, 400, 3000]))]
    placed = sharding.longest_first(list(enumerate(sizes)), n)
    want = defaultdict(Counter)
    for item, shard in placed.items():
        want[sizes[item]][shard] += 1
    got = sharding.dealt(sorted(Counter(sizes).items()), n)
    assert {s: Counter({k: c for k, c in enumerate(own) if c}) for s, own in got} == want


@pytest.mark.parametrize("heavy,sizes", [(10_000, 100_000), (20, 0)])
def test_loads(spark, monkeypatch, heavy, sizes):
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    monkeypatch.setattr(sharding, "BROADCAST_SIZES", sizes)
    rng = random.Random(1)
    rows = [(k, "x" * rng.choice([0, 3, 5, 5, 5, 200, 1 + rng.randrange(900)]) + (str(k) if rng.random() < 0.7 else "")) for k in range(1500)]
    rows += [(2000 + k, "a hot text") for k in range(700)] + [(None, None), (None, "z"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("s")).withColumn("bytes", F.lit(0))
    got = sharding.shards(docs, 16).collect()
    assert len(got) == len(rows)
    groups = Counter()
    for _, text in rows:
        groups[text or ""] += len(text or "") + 1
    plain = sharding.longest_first(list(enumerate(groups.values())), 16)
    want = Counter()
    for item, shard in plain.items():
        want[shard] += list(groups.values())[item]
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == sorted(want.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
