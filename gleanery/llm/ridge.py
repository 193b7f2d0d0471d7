"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are computed once and written to the shared folder. The labelled rows' Fourier features are
summed partition by partition into normal equations, fold by fold, so that leave-one-fold-out solutions cost no further
pass. The out-of-fold scores, counted in BINS bins, are calibrated by pooling adjacent violators. What reaches the driver
is a few matrices and the bins, whatever the input's size. Every labelled row is used.

Defined results: null text counts as empty; several labels of a document count by their mean, null labels not at all; a
row with a null id is scored but never learnt from; without labels of both kinds every score is the mean label (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, map_arrow, pieces, utf8

FEATURES = 96
FOLDS = 3
BINS = 512
GAMMA = 0.04
PENALTY = 1e-2
STATS = 22


def statistics(data: np.ndarray, off: np.ndarray, texts: list[str]) -> np.ndarray:
    """STATS numbers about each whole text, most between 0 and 1."""
    n = np.diff(off)
    rows = len(n)
    owner = np.repeat(np.arange(rows), n)
    kind = np.zeros(256, np.int64)
    for k, chars in enumerate((b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#$%&*@^~+=", b"|<>{}[]()\\/_", b"\"'`-"), 1):
        kind[list(chars)] = k
    kind[128:] = 12
    counts = np.bincount(owner * 13 + kind[data], minlength=rows * 13).reshape(rows, 13).astype(np.float64)
    size = np.maximum(n, 1).astype(np.float64)
    out = np.zeros((rows, STATS))
    out[:, :13] = counts / size[:, None]
    out[:, 13] = np.log1p(n) / 12
    for k, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        out[k, 14] = np.log1p(m) / 10
        out[k, 15] = min(lengths.mean() / 20, 2)
        out[k, 16] = min(lengths.std() / 10, 2)
        out[k, 17] = len(set(words)) / m
        out[k, 18] = sum(map(str.__eq__, words, words[1:])) / m
        lines = text.split("\n")
        out[k, 19] = len(set(lines)) / len(lines)
        out[k, 20] = min(m / len(lines) / 100, 2)
        out[k, 21] = sum(w.isupper() and len(w) > 1 for w in words) / m
    out[:, :13] = np.sqrt(out[:, :13])
    out[:, 18] = np.sqrt(out[:, 18])
    out[:, 21] = np.sqrt(out[:, 21])
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        texts = [t or "" for t in part.column("text").to_pylist()]
        x = statistics(*utf8(part.column("text")), texts)
        stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), stats], ["doc_id", "stats"])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fourier(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(STATS, FEATURES)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, FEATURES)


def features(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray], waves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - scale[0]) / scale[1], -6, 6) @ waves[0] + waves[1])
    return np.hstack((z, np.ones((len(z), 1))))


def pooled(score: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: (scores, levels), both rising."""
    blocks: list[list[float]] = []
    for s, w, t in zip(score, weight, target, strict=True):
        blocks.append([s * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs. held_out: Column over doc_id; no label of such a row is learnt."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = as_table(map_arrow(rows, _stats, "doc_id long, stats array<double>"), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = as_table(stats.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "train")
    moments = train.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), *(f(F.col("stats")[k]) for k in range(STATS) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0] or moments[2] == moments[3]:
        constant = F.lit(float(moments[1]) if moments[0] else 0.5)
        return _result(stats.withColumn("score", constant), held_out, threshold)
    scale = np.array(moments[4::2]), np.maximum(np.array(moments[5::2]), 1e-3)
    waves, upper = fourier(), np.triu_indices(FEATURES + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
        for b in batches:
            if b.num_rows:
                z, y, fold = features(matrix(b.column("stats")), scale, waves), b.column("y").to_numpy(), b.column("fold").to_numpy()
                for f in range(FOLDS):
                    gram[f] += z[fold == f].T @ z[fold == f]
                    right[f] += z[fold == f].T @ y[fold == f]
        if right.any() or gram.any():
            blob = np.concatenate([*(g[upper] for g in gram), *right])
            yield pa.RecordBatch.from_arrays([pa.array([blob.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for blob in b.column("sums").to_pylist():
                total = total + np.frombuffer(blob)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    partial = map_arrow(map_arrow(train, sums, "sums binary").repartition(32), add, "sums binary")
    total = np.sum([np.frombuffer(r[0]) for r in partial.collect()], axis=0)  # 32 blobs at most
    n = len(upper[0])
    grams = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1))
    for f in range(FOLDS):
        grams[f][upper] = total[f * n : (f + 1) * n]
        grams[f] = np.maximum(np.abs(grams[f]), np.abs(grams[f].T)) * np.where(np.abs(grams[f]) >= np.abs(grams[f].T), np.sign(grams[f]), np.sign(grams[f].T))
    rights = total[FOLDS * n :].reshape(FOLDS, -1)
    ridge = np.eye(FEATURES + 1) * PENALTY * max(1.0, np.sqrt(moments[0]))
    weights = np.linalg.solve(grams.sum(axis=0) + ridge, rights.sum(axis=0))
    others = np.array([np.linalg.solve(grams.sum(axis=0) - grams[f] + ridge, rights.sum(axis=0) - rights[f]) for f in range(FOLDS)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, fold = features(matrix(b.column("stats")), scale, waves), b.column("fold").to_numpy()
                raw = (z * others[fold]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), pa.array(raw), b.column("y")], ["bin", "raw", "y"])

    bins = map_arrow(train, scored, "bin int, raw double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.sum("y").alias("y")).collect()
    at, level = pooled(*np.array([(r["raw"], r["n"], r["y"]) for r in sorted(bins, key=lambda r: r["bin"])]).T)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = features(matrix(b.column("stats")), scale, waves) @ weights
                calibrated = np.interp(raw, at, level) + 1e-9 * np.tanh(raw)  # equal levels keep the order of the raw score
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(calibrated, 0, 1))], ["doc_id", "score"])

    return _result(map_arrow(stats.select("doc_id", "stats"), score, "doc_id long, score double"), held_out, threshold)


def _result(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
