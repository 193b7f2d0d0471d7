"""Exact top-k inner products over norm-sorted vectors.

Components become floor(64 * x), so scores are exact integers. Candidate vectors are rotated by the eigenvectors of their
second moments (the SVD of the table), written in ranges of falling length, and met by blocks of queries: each task walks
its vectors from the longest on, skips a block when no query can reach its k-th best score with that length, and sums the
rotated parts stage by stage (STAGES): after each one it keeps the pairs whose partial sum plus the Cauchy-Schwarz bound of
the rest can still reach the k-th best score. What is left is scored on the integers. The k-th best scores start from the
SEED longest vectors of all.

A query block holds QUERY_BLOCK vectors, so what travels to the tasks is bounded; blocks follow one another, each a pass
over the vectors that recovers from lost executors on its own and leaves its rows in one folder.

Scores are integers of any size: they are ranked as such. `score` is null where 64 bits don't hold it, `digits` has it always.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id;
shorter vectors count as padded with zeros; every row is a candidate of its own, repeated ones too; a query given twice
answers once for each distinct vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, map_arrow, n_partitions, shared_path

QUERY_BLOCK = 8192
SEED = 2048
BLOCK = 1024
#: So many queries meet a block of vectors at a time.
ROWS = 512
#: Parts of the rotated components that are summed before each bound.
STAGES = (0.125, 0.25, 0.5)
#: Floats hold squares of components up to this power of two.
EXPONENT = 480


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components rounded down to whole 64ths, exactly, with the length and the largest component."""
    for b in batches:
        ids, out, norm, top = [], [], [], []
        for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    scaled = np.floor(64.0 * x)
                    x = np.where(np.isfinite(scaled), scaled / 64.0, x) + 0.0  # where 64 x overflows, x is whole; no -0.0
                    norm.append(float(np.sqrt((x * x).sum())))
                ids.append(i)
                out.append(x)
                top.append(float(np.abs(x).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64())), pa.array(norm, pa.float64()), pa.array(top, pa.float64())], ["id", "x", "norm", "top"])


def _padded(column, d: int) -> np.ndarray:
    """The lists of a column as rows of d numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    out = np.zeros((len(column), d))
    n = np.diff(off)
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(row)) - np.repeat(off[:-1] - off[0], n)] = flat[off[0] : off[-1]]
    return out


def shift(top: float) -> int:
    """The power of two to divide integers by, so that floats hold their squares; 0 unless they are huge."""
    return max(0, math.frexp(top)[1] + 6 - EXPONENT)


def _whole(x: np.ndarray) -> np.ndarray:
    """Python's integers of whole numbers."""
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def _times_64(x: np.ndarray, power: int) -> np.ndarray:
    return 64.0 * x if power == 0 else np.array([[int(c) * 64 if abs(c) > 2.0**60 else int(64.0 * c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def scored(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows q[i] and x[j] of integers (floats or not): int64, or Python's integers where those may
    not do."""
    if not len(i):
        return np.zeros(0, np.int64)
    top = math.log2(np.abs(q).max() or 1) + math.log2(np.abs(x).max() or 1) + math.log2(q.shape[1])
    if top < 53:
        q, x, kind = q.astype(np.float64), x.astype(np.float64), np.float64
        if 8 * len(i) > len(q) * len(x):  # most pairs are wanted: all at once is cheaper
            return (q @ x.T)[i, j].astype(np.int64)
    elif top < 62:
        q, x, kind = q.astype(np.int64), x.astype(np.int64), np.int64
    else:
        (q, x), kind = (_whole(m) for m in (q, x)), object
    out = np.zeros(len(i), kind)
    for lo in range(0, len(i), 16_384):
        out[lo : lo + 16_384] = (q[i[lo : lo + 16_384]] * x[j[lo : lo + 16_384]]).sum(axis=1)
    return out.astype(np.int64) if kind is np.float64 else out


def _floats(scores: np.ndarray, power: int) -> np.ndarray:
    """Scores as floats in the scale of vectors that were divided by 2**power."""
    if scores.dtype != object:
        return np.ldexp(scores.astype(np.float64), -2 * power)
    out = []
    for s in scores.tolist():
        drop = max(0, abs(s).bit_length() - 64)
        out.append(math.ldexp(float(s >> drop), drop - 2 * power))
    return np.array(out, np.float64)


def key(score: int) -> str:
    """Text in the order of integers of up to 10**5 digits."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda t: (-scores[t], ids[t]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def _survivors(q: np.ndarray, r: np.ndarray, least: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose partial sums plus the bound of the rest reach `least`, stage by stage."""
    i = j = partial = None
    for a, e in zip([0, *edges[:-1]], edges, strict=True):
        q_rest, r_rest = np.sqrt((q[:, e:] ** 2).sum(axis=1)), np.sqrt((r[:, e:] ** 2).sum(axis=1))
        if i is None or 8 * len(i) > len(q) * len(r):
            total = q[:, :e] @ r[:, :e].T
            reach = total + q_rest[:, None] * r_rest >= least[:, None]
            if i is not None:
                was = np.zeros_like(reach)
                was[i, j] = True
                reach &= was
            i, j = np.nonzero(reach)
            partial = total[i, j]
        else:
            keep = []
            for lo in range(0, len(i), 65_536):
                u, v = i[lo : lo + 65_536], j[lo : lo + 65_536]
                partial[lo : lo + 65_536] += (q[u, a:e] * r[v, a:e]).sum(axis=1)
                keep.append(partial[lo : lo + 65_536] + q_rest[u] * r_rest[v] >= least[u])
            keep = np.concatenate(keep)
            i, j, partial = i[keep], j[keep], partial[keep]
        if not len(i):
            break
    return i, j


def _searcher(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int, power: int, wide: bool):
    d = queries.shape[1]
    edges = sorted({max(1, int(d * part)) for part in STAGES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_whole = np.ldexp(queries, 6 - power) @ rotation, _times_64(queries, power)
        q_norm = np.sqrt((q * q).sum(axis=1))
        least = floor.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x, ids = _padded(b.column("x"), d), b.column("id").to_numpy()
                r = np.ldexp(x, 6 - power) @ rotation
                longest = float(np.sqrt((r * r).sum(axis=1).max()))
                slack = 1e-6 * (1 + longest * q_norm)
                live = np.flatnonzero(q_norm * longest + slack >= least)
                x_whole = _times_64(x, power) if len(live) else None
                # shorter vectors of this task can't do better, but the next batch may be another file's
                for lo in range(0, len(live), ROWS):
                    some = live[lo : lo + ROWS]
                    i, j = _survivors(q[some], r, least[some] - slack[some], edges)
                    score = scored(q_whole[some], x_whole, i, j) if len(i) else np.zeros(0, np.int64)
                    i = some[i]
                    keep = (query_ids[i] != ids[j]) & (_floats(score, power) + slack[i] >= least[i])
                    i, j, score = i[keep], j[keep], score[keep]
                    rows, edge = np.unique(i, return_index=True)
                    edge = np.append(edge, len(i)).tolist()
                    for row, a, z in zip(rows.tolist(), edge[:-1], edge[1:], strict=True):
                        mine, points = ids[j[a:z]], score[a:z]
                        if row in best:
                            mine, points = np.concatenate((best[row][0], mine)), np.concatenate((best[row][1], points))
                        top = _best(mine, points, k)
                        best[row] = mine[top], points[top]
                        if len(top) == k:
                            least[row] = max(least[row], _floats(points[top[-1:]], power)[0])
        for row, (mine, points) in best.items():
            n = len(mine)
            values = points.tolist()
            short = [s if -(2**63) <= s < 2**63 else None for s in values]
            keys = [key(s) for s in values] if wide else [None] * n
            digits = [str(s) for s in values]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row, np.int32)), pa.array(np.full(n, query_ids[row], np.int64)), pa.array(mine), pa.array(short, pa.int64()), pa.array(digits), pa.array(keys, pa.string())], ["row", "query_id", "vec_id", "score", "digits", "key"])

    return run


def _moments(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                d = int(np.diff(b.column("x").offsets.to_numpy()).max())
                x = np.ldexp(_padded(b.column("x"), d), 6 - power)
                gram = x.T @ x
                if total is None or len(total) < d:
                    grown = np.zeros((d, d))
                    if total is not None:
                        grown[: len(total), : len(total)] = total
                    total = grown
                total[:d, :d] += gram
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((0, 0))
    for b in batches:
        for blob in b.column("gram").to_pylist():
            flat = np.frombuffer(blob)
            d = int(round(len(flat) ** 0.5))
            small, large = sorted((total, flat.reshape(d, d)), key=len)
            total = large.copy()
            total[: len(small), : len(small)] += small
    if len(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])


RESULT = "query_id long, rank int, vec_id long, score long, digits string"


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, digits): the k highest inner products of each query row with every row but its own."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = as_table(map_arrow(rows, _clean, "id long, x array<double>, norm double, top double"), "vectors")
    size, top = clean.agg(F.max(F.size("x")), F.max("top")).first()
    if size is None:
        return spark.createDataFrame([], RESULT)
    d, power = max(size, 1), shift(top)
    wide = power > 0 or d * 4096.0 * top * top >= 2.0**62  # 64 bits may not hold the scores
    grams = [r[0] for r in map_arrow(map_arrow(clean, _moments(power), "gram binary").repartition(8), _added, "gram binary").collect()]  # 8 at most
    total = np.zeros((d, d))
    for blob in grams:
        own = int(round((len(blob) // 8) ** 0.5))
        total[:own, :own] += np.frombuffer(blob).reshape(own, own)
    rotation = np.linalg.eigh(total)[1][:, ::-1]
    ranged = as_table(clean.repartitionByRange(n_partitions(spark), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"), "ranged")
    longest = ranged.orderBy(F.desc("norm"), "id").limit(SEED).collect()
    seed_ids = np.array([r["id"] for r in longest], np.int64)
    seed = np.ldexp(_padded(pa.array([r["x"] for r in longest], pa.list_(pa.float64())), d), 6 - power)
    queries = as_table(ranged.where(is_query).select("id", "x").dropDuplicates().withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(1 << 20))), "queries")
    n = queries.count()
    n_blocks = max(1, -(-n // QUERY_BLOCK))
    path = shared_path(spark, "found")
    written = False
    for block in range(n_blocks):
        lo, hi = ((1 << 20) * b // n_blocks for b in (block, block + 1))
        own = queries.where((F.col("block") >= lo) & (F.col("block") < hi)).orderBy("id", "x").collect()  # about QUERY_BLOCK rows
        if not own:
            continue
        ids = np.array([r["id"] for r in own], np.int64)
        q = _padded(pa.array([r["x"] for r in own], pa.list_(pa.float64())), d)
        floor = np.full(len(q), -np.inf)
        for a in range(0, len(q), 512):
            mine = np.ldexp(q[a : a + 512], 6 - power)
            scores = mine @ seed.T
            scores[ids[a : a + 512, None] == seed_ids] = -np.inf
            if len(seed) > k:
                kth = np.partition(scores, len(seed) - k, axis=1)[:, len(seed) - k]
                # less than rounding can take away, whatever cancels in the sum
                floor[a : a + 512] = kth - 1e-9 * np.sqrt((mine * mine).sum(axis=1)) * np.sqrt((seed * seed).sum(axis=1).max()) - 1
        part = map_arrow(ranged, _searcher(q, ids, floor, rotation, k, power, wide), "row int, query_id long, vec_id long, score long, digits string, key string")
        order = [F.desc("key" if wide else "score"), F.asc("vec_id")]
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("row", "query_id").orderBy(*order)))
        ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "digits").write.parquet(f"{path}/block-{block}")
        written = True
    return spark.read.schema(RESULT).parquet(f"{path}/block-*") if written else spark.createDataFrame([], RESULT)
