"""Transducers, their composition and the toxicity grammar against enumeration."""

import random
from itertools import product

import pytest

from gleanery.llm import toxicity
from gleanery.llm.transducers import Transducer, compose, nearby, scope


def machine(rng, letters, states=3):
    arcs = {s: {a: [(rng.choice(letters), rng.choice([0.5, 1.0, 2.0]), rng.randrange(states)) for _ in range(rng.choice([0, 1, 1, 2]))] for a in letters} for s in range(states)}
    return Transducer(arcs, {s for s in range(states) if rng.random() < 0.6})


@pytest.mark.parametrize("seed", range(25))
def test_composition_is_the_relation(seed):
    rng = random.Random(seed)
    a, b = machine(rng, "xyz"), machine(rng, "xyz")
    both = compose(a, b)
    for n in range(5):
        for word in product("xyz", repeat=n):
            want = {}
            for middle, f in a.paths(word).items():
                for out, g in b.paths(middle).items():
                    want[out] = max(want.get(out, 0.0), f * g)
            assert both.paths(word) == want


def plain(tokens):
    """The grammar's meaning, token by token."""
    sums = [0.0] * 4
    for at, (kind, weight) in enumerate(tokens):
        if kind not in "IK":
            continue
        before = lambda c, n: any(tokens[p][0] == c for p in range(max(0, at - n), at))
        damped = False
        if before("N", toxicity.NEGATION_SCOPE):
            weight, damped = weight * toxicity.NEGATION_FACTOR, True
        if before("R", toxicity.REPORT_SCOPE):
            weight, damped = weight * toxicity.REPORT_FACTOR, True
        near = any(tokens[p][0] == "Y" for p in range(max(0, at - toxicity.TARGET_SCOPE), min(len(tokens), at + toxicity.TARGET_SCOPE + 1)))
        if kind == "K" and not near:
            continue
        kind = "damped" if damped else "threat" if kind == "K" else "directed" if near else "plain"
        sums[toxicity.MATCHES[kind]] += weight * (toxicity.TARGET_FACTOR if near else 1.0)
    return sums


def test_grammar_on_all_short_clauses():
    g = toxicity.Grammar({}, {})
    for n in range(6):
        for word in product("IKYNRO", repeat=n):
            tokens = [(c, 1.0 + 0.25 * k) for k, c in enumerate(word)]
            assert g.clause(tokens) == pytest.approx(plain(tokens)), word


def test_grammar_on_long_clauses():
    rng = random.Random(2)
    g = toxicity.Grammar({}, {})
    for _ in range(300):
        tokens = [(rng.choice("IKYNR" + "O" * rng.choice([1, 20])), rng.choice([0.5, 2.0])) for _ in range(rng.randrange(80))]
        assert g.clause(tokens) == pytest.approx(plain(tokens))


def test_scopes():
    s = scope("N", 2, 0.5, {"I": "J"}, "INO")
    assert s.paths("NOII") == {("N", "O", "J", "I"): 0.5} and s.paths("NNIII") == {("N", "N", "J", "J", "I"): 0.25}
    t = nearby("Y", 1, {"I": ("D", 2.0)}, {"I": ("P", 1.0)}, "IYO")
    assert t.paths("IY") == {("P", "Y"): 1.0, ("D", "Y"): 2.0} and t.paths("IOY") == {("P", "O", "Y"): 1.0} and t.paths("YI") == {("Y", "D"): 2.0}


def test_lexicon_keeps_what_beats_its_beginnings():
    words, stems = toxicity.lexicon({"=vile": 40, "vil": 40, "vile": 20, "=vilest": 30, "=idiot": 9, "=rare": 2}, {"vil": 2}, 100, 1000)
    g = toxicity.Grammar(words, stems)
    assert set(stems) == {"vil", "vile"} - ({"vile"} if g.stems.get("vile") is None else set()) and "idiot" in words and "rare" not in words
    assert g.insult("vilest") == max(words.get("vilest", 0), stems["vil"], stems.get("vile", 0)) and g.insult("village") == stems["vil"]


def test_held_out_words_are_not_learnt(spark):
    """A word that stands only in documents of one fold is in no lexicon that gives that fold's features."""
    from pyspark.sql import functions as F

    rows = [(i, ("vile " if i % 2 else "") + f"word{i % 7} text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    grammar, _ = toxicity.learn(docs, labels, F.lit(False))
    assert grammar.insult("vile") > 3 and grammar.insult("text") == 0
    noise = labels.withColumn("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    scores = [r["score"] for r in toxicity.toxicity_scores(docs, noise, F.lit(False)).collect()]
    assert max(scores) < 0.9  # noise isn't learnt by heart
