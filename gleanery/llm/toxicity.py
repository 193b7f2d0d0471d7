"""Toxicity by a weighted finite-state pattern grammar.

A lexicon labels the tokens of a clause: INSULT (words and word beginnings that mark toxic documents, with learnt weights),
THREAT, TARGET, NEGATION, REPORT, or none of them. Three transducers are composed into the grammar: NEGATION and REPORT open
scopes in which insults and threats are damped, TARGET makes an insult near it a directed one and is what a threat needs to
be one at all. The best path through the composition gives a clause's matches by kind; a document's features come from its
matched clauses, and a logistic model turns them into a score. Insult weights and the logistic model are learnt from labelled
rows; the features that the model learns from come from lexicons that have not seen the row (FOLDS).

The closed classes are fixed words of four languages. The language of a row is never an input, so insults are learnt over
all languages at once.

Learning takes at most about `TRAIN_ROWS` labelled rows (a hash of the id decides which); all rows are scored, whole.

Defined results: null text counts as empty; several labels of a document count by their maximum, null labels not at all; a
row with a null id is scored but never learnt from; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, map_arrow, n_partitions, pieces
from gleanery.llm.transducers import compose, nearby, scope

TRAIN_ROWS = 40_000
FOLDS = 8
#: Beginnings of these lengths are candidates besides whole words.
STEMS = (3, 4, 5, 6, 7)
#: Least log odds of a term of the lexicon.
BAR = 1.8
#: A task sums up so many terms at a time.
FLUSH = 200_000
CLAUSE = re.compile(r"[.!?;:\n|]+|,\s|\s(?:but|and then|aber|sondern|mais|pero)\s")
WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words, for verbs with many forms.
THREAT = tuple("kill murder hurt destroy beat stab shoot burn punch strangl crush töte umbring schlag erschieß verprügel verbrenn tuer frapper étrangl brûler poignard matar golpe destru apuñal quemar dispar".split())
TARGET = frozenset("you your yours u they them these those he him she her people du dich dir dein deine ihr euch sie tu te toi vous ton votre ils elles lui eux tú te ti usted ustedes vosotros ellos ellas".split())
NEGATION = frozenset("not no never nobody nothing none without cannot nicht kein keine keinen nie niemals niemand ohne ne pas jamais rien aucun sans nunca jamás nadie nada ninguno sin".split())
REPORT = frozenset("said says say quoted wrote claimed reported called calls quote sagte sagt schrieb behauptete nannte zitierte dit écrit appelé cité dijo dice escribió llamó citó".split())
#: Symbols: insult, threat, target, negation, report, other; J and L are damped insults and threats.
ALPHABET = "IKYNROJL"
#: How far, in tokens, a scope reaches, and by how much it damps; how near a target must be, and by how much it strengthens.
NEGATION_SCOPE, NEGATION_FACTOR = 2, 0.5
REPORT_SCOPE, REPORT_FACTOR = 4, 0.7
TARGET_SCOPE, TARGET_FACTOR = 3, 1.2
THREAT_WEIGHT = 1.0
DAMPED = {"I": "J", "K": "L", "J": "J", "L": "L"}
#: What a clause's matches are: plain insults, directed insults, damped ones, threats.
MATCHES = {"plain": 0, "directed": 1, "damped": 2, "threat": 3}
FEATURES = 10


def grammar():
    """The composition: negation, then reported speech, then targets."""
    parts = (
        scope("N", NEGATION_SCOPE, NEGATION_FACTOR, DAMPED, ALPHABET),
        scope("R", REPORT_SCOPE, REPORT_FACTOR, DAMPED, ALPHABET),
        nearby(
            "Y", TARGET_SCOPE,
            {"I": ("directed", TARGET_FACTOR), "J": ("damped", TARGET_FACTOR), "K": ("threat", TARGET_FACTOR), "L": ("damped", TARGET_FACTOR)},
            {"I": ("plain", 1.0), "J": ("damped", 1.0), "K": ("O", 1.0), "L": ("O", 1.0)},
            ALPHABET,
        ),
    )
    return reduce(compose, parts)


OTHER = "O", 0.0
#: Runs of other tokens beyond this leave no scope open and no target near.
GAP = max(NEGATION_SCOPE, REPORT_SCOPE, TARGET_SCOPE)


class Grammar:
    """A lexicon of insults with the fixed classes, and the composed transducer that reads a clause."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.fixed = {w: (c, 0.0) for c, ws in (("Y", TARGET), ("N", NEGATION), ("R", REPORT)) for w in ws}
        #: First three letters of every insult or threat; most words are told by them.
        self.heads = {w[:3] for w in (*words, *stems, *THREAT)}
        self.machine = grammar()

    def insult(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), 0.0)

    def label(self, word: str) -> tuple[str, float]:
        """Symbol and weight of a word that is not of a closed class."""
        if (w := self.insult(word)) > 0:
            return "I", w
        return ("K", THREAT_WEIGHT) if word.startswith(THREAT) else OTHER

    def clause(self, tokens: list[tuple[str, float]]) -> tuple[float, ...]:
        """Weights of a clause's matches, by kind."""
        short, gap = [], 0
        for token in tokens:
            gap = gap + 1 if token[0] == "O" else 0
            if gap <= GAP:
                short.append(token)
        return self.machine.best(short, MATCHES)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        known: dict[str, tuple[str, float]] = {}  # insults and threats, and what begins like them
        live: set[str] = set()
        heads, fixed = self.heads, self.fixed
        for k, text in enumerate(texts):
            text = text.lower()
            words = WORD.findall(text)
            out[k, 0] = np.log1p(len(words)) / 5
            distinct = set(words)
            if len(known) > 500_000:
                known, live = {}, set()
            for w in [w for w in distinct if w[:3] in heads]:
                if w not in known:
                    known[w] = OTHER if w in fixed else self.label(w)
                    if known[w][0] in "IK":
                        live.add(w)
            if live.isdisjoint(distinct):
                continue
            weights, sums = [], np.zeros(len(MATCHES))
            for clause in CLAUSE.split(text):
                own = WORD.findall(clause)
                if not live.isdisjoint(own):
                    matched = self.clause([fixed.get(w) or known.get(w, OTHER) for w in own])
                    if (weight := sum(matched)) > 0:
                        weights.append(weight)
                        sums += matched
            if weights:
                insults = {w: known[w][1] for w in live & distinct if known[w][0] == "I"}
                strong = sum(map(Counter(words).__getitem__, (w for w, x in insults.items() if x >= 3)))
                total, top = sum(weights), sorted(weights, reverse=True)
                out[k, 1:] = (np.log1p(total), np.log1p(top[0]), np.log1p(sum(top[:3])), np.log1p(1000 * total / (len(words) + 50)), np.log1p(strong), np.log1p(len(insults)), *np.log1p(sums[1:]))
        return out


def _candidates(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {"=" + w for w in words if 2 < len(w) <= 24} | {w[:n] for n in STEMS for w in words if len(w) > n}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of documents that hold a term, by label and fold."""
    seen: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "part", "n"])
        seen.clear()
        return batch

    for part in pieces(batches, "text"):
        for text, group in zip(part.column("text").to_pylist(), part.column("part").to_pylist(), strict=True):
            seen.update((t, group) for t in _candidates(text or ""))
            if len(seen) >= FLUSH:
                yield flushed()
    yield flushed()


def odds(n: float, c: float, n_toxic: int, n_clean: int) -> float:
    return float(np.log((n + 0.1) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))


def least(n_toxic: int) -> int:
    """In how many toxic documents a term must stand."""
    return max(3, n_toxic // 400)


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log odds over BAR) of words and stems; a longer term must beat the shorter ones that contain it."""
    good = {t: s for t, n in toxic.items() if n >= least(n_toxic) and (s := odds(n, clean.get(t, 0), n_toxic, n_clean)) > BAR}
    words, stems = {}, {}
    for t in sorted(good, key=lambda t: (t[0] == "=", len(t))):
        text = t.removeprefix("=")
        if good[t] > max((stems.get(text[:n], 0.0) for n in STEMS if n <= len(text)), default=0.0):
            (words if t[0] == "=" else stems)[text] = good[t]
    return words, stems


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method; returns (mean, scale, weights with the constant last)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def learn(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """(grammar, logistic model) from the labels of rows that held_out doesn't hold; None without labels of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = F.lit(min(1.0, TRAIN_ROWS / max(n, 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)) + FOLDS * (F.col("y") == 1).cast("int")).cast("int"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # TRAIN_ROWS pairs of numbers, about, are broadcast; the texts that they choose are dealt out evenly
    train = as_table(rows.join(F.broadcast(chosen), "doc_id").select("text", "part").repartition(n_partitions(docs.sparkSession)), "toxic-train")
    size = {r["part"]: r["count"] for r in train.groupBy("part").count().collect()}
    n_clean, n_toxic = ([size.get(FOLDS * y + k, 0) for k in range(FOLDS)] for y in (0, 1))
    if not sum(n_toxic) or not sum(n_clean):
        return None
    parts = [F.coalesce(F.sum(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(2 * FOLDS)]
    counted = map_arrow(train, _terms, "term string, part int, n long").groupBy("term").agg(*parts)
    whole = lambda y, but=None: reduce(lambda a, b: a + b, (F.col(f"n{FOLDS * y + k}") for k in range(FOLDS) if k != but))

    def good(but: int | None = None):
        toxic, clean = (sum(x) - (0 if but is None else x[but]) for x in (n_toxic, n_clean))
        log_odds = F.log((whole(1, but) + 0.1) / (toxic + 1)) - F.log((whole(0, but) + 0.5) / (clean + 1))
        return (whole(1, but) >= least(toxic)) & (log_odds > BAR - 1e-6)

    # only terms of some lexicon leave the executors
    found = counted.where(reduce(lambda a, b: a | b, (good(k) for k in (None, *range(FOLDS))))).toArrow().to_pydict()

    def made(but: int | None = None) -> Grammar:
        counts = []
        for y in (1, 0):
            columns = [found[f"n{FOLDS * y + k}"] for k in range(FOLDS) if k != but]
            counts.append({t: sum(c) for t, c in zip(found["term"], zip(*columns, strict=True), strict=True)})
        toxic, clean = (sum(x) - (0 if but is None else x[but]) for x in (n_toxic, n_clean))
        return Grammar(*lexicon(*counts, toxic, clean))

    others = [made(k) for k in range(FOLDS)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            group, texts = part.column("part").to_numpy(), [t or "" for t in part.column("text").to_pylist()]
            x = np.zeros((len(texts), FEATURES))
            for k in range(FOLDS):
                own = np.flatnonzero(group % FOLDS == k)
                x[own] = others[k].features([texts[i] for i in own])
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(group // FOLDS, pa.int32())], ["x", "y"])

    seen = map_arrow(train, measured, "x array<double>, y int").collect()  # bounded by TRAIN_ROWS
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    order = np.lexsort((y, *x.T))
    return made(), logistic(x[order], y[order])


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    model = learn(docs, labels, held_out, label, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scored(rows, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _score(model, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    grammar, (mean, scale, w) = model
    z = (grammar.features(texts) - mean) / scale
    return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def _scored(rows: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_score(model, [t or "" for t in part.column("text").to_pylist()]))], ["doc_id", "score"])

    return map_arrow(rows, run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores threshold or more; the columns stay as they are."""
    model = learn(docs, labels, held_out, text_col=text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col):
            keep = _score(model, [t or "" for t in part.column(text_col).to_pylist()]) < threshold
            yield part.filter(pa.array(keep))

    return map_arrow(docs.select(*names), run, docs.schema)
