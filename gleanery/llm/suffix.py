"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier.

All windows of LENGTH bytes are dealt out by their minimizer (the leftmost least hash of a GRAM-byte gram), which equal
windows share, so equal windows meet wherever they stand:

1. Each task cuts its texts into runs of windows with one minimizer and sums up equal runs (hashes of the run's bytes) at
   once: the earliest stays, the others are repeats. What is left goes to buckets by minimizer, as packed columns; but a
   minimizer with more than SPLIT different runs in the task (the edges of a very frequent passage) is split window by window,
   and only a mark goes to its bucket. A minimizer puts at most SPLIT of FLUSH runs of any task into one bucket.
2. A bucket drops minimizers that occur once, again sums up equal runs, and keeps minimizers with several different runs;
   those with more than HOT, or with a mark, are split window by window too.
3. Those runs' bytes are fetched and suffix-sorted bucket by bucket, in two stages: only suffixes smaller than their
   successors are sorted directly (LENGTH bytes deep), the others are induced by scanning the buckets of first bytes.
   Neighbours whose common prefix has LENGTH bytes are equal windows; all but the earliest are repeats. Split windows meet
   by their own hashes instead.

Positions are then joined to the texts by document. Runs that count as equal without a look at their bytes, and windows of
split minimizers, agree in two independent hashes of 64 bits each, besides their minimizer; other windows are compared byte
by byte.

Defined results: null and empty texts have nothing to remove; nor have texts of fewer than LENGTH bytes or rows with a null
id (they aren't compared either); rows that repeat an id and text count as one document, and each gets its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, fresh, map_arrow, n_partitions, pieces, ranges, utf8
from gleanery.llm.shingles import _BYTE, _BYTE_2, mix, powers

LENGTH = 100
GRAM = 24
WIDTH = LENGTH - GRAM + 1
HOT = 256
#: A task sums up equal runs over so many runs at a time; a minimizer with more than SPLIT different ones among them is split at once.
FLUSH = 500_000
SPLIT = 64
_POS = np.uint64((1 << 26) - 1)
_RUN = np.dtype([("fp", "<u8"), ("sh", "<u8"), ("s2", "<u8"), ("doc", "<i8"), ("s0", "<i4"), ("n", "<i4")])


def _sums(data: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, with the factors that move a difference to the start."""
    up, down = powers(len(data) + 1, second)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_2 if second else _BYTE)[data] * up[: len(data)], out=total[1:])
    return total, down


def runs(data: np.ndarray, off: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Runs of windows with one minimizer: fingerprints, hashes of the runs' bytes, and where they start (by document)."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, _RUN)
    if n > (stretch := int(_POS) + 1):  # positions fill _POS: texts go in stretches that share no window
        found = []
        for doc, a, b in zip(docs, off[:-1].tolist(), off[1:].tolist(), strict=True):
            for lo in range(a, b, stretch - LENGTH + 1):
                hi = min(lo + stretch, b)
                found.append(runs(data[lo:hi], np.array([0, hi - lo]), np.array([doc])))
                found[-1]["s0"] += lo - a
        return np.concatenate(found)
    total, down = _sums(data)
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    key = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span :])
    least = (least & _POS).astype(np.int64)  # by window start: where its minimizer stands
    valid = np.zeros(n - LENGTH + 2, np.int8)
    first, last = off[:-1], off[1:] - LENGTH
    has = last >= first
    np.add.at(valid, first[has], 1)
    np.add.at(valid, last[has] + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.ones(len(valid), bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    change[first[has]] = True
    start = np.flatnonzero(change & valid)
    stop = np.append(np.flatnonzero(change | ~valid), len(valid))
    end = stop[np.searchsorted(stop, start, "right")]  # one past the last window start
    at = least[start]
    out = np.zeros(len(start), _RUN)
    out["fp"] = mix(gram[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(16)
    body = mix((total[end - 1 + LENGTH] - total[start]) * down[start])
    shape = ((at - start).astype(np.uint64) << np.uint64(16)) + (end - start).astype(np.uint64)
    out["sh"] = mix(body + shape * np.uint64(0x9E3779B97F4A7C15))
    total, down = _sums(data, second=True)
    out["s2"] = mix((total[end - 1 + LENGTH] - total[start]) * down[start] + shape)
    owner = np.searchsorted(off, start, "right") - 1
    out["doc"] = docs[owner]
    out["s0"] = start - off[owner]
    out["n"] = end - start
    return out


def summed(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest of each distinct run, the later ones); the same place twice counts once."""
    found = found[np.lexsort((found["s0"], found["doc"], found["s2"], found["sh"], found["fp"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["fp"][1:] != found["fp"][:-1]) | (found["sh"][1:] != found["sh"][:-1]) | (found["s2"][1:] != found["s2"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(found) else np.zeros(0, np.int64)
    later = ~new & ((found["doc"] != found["doc"][head]) | (found["s0"] != found["s0"][head]))
    return found[new], found[later]


def joined(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated runs as (doc, first, last) of window starts, merged where the runs meet."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = found[np.lexsort((found["s0"], found["doc"]))]
    doc, lo, hi = found["doc"], found["s0"].astype(np.int64), found["s0"].astype(np.int64) + found["n"] - 1
    new = np.ones(len(found), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + LENGTH)
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


#: Bytes of a packed run: 6 of fp, 8 of each hash, 8 of doc, 4 of s0 and of n.
_WIDTH = 38


def _pack(found: np.ndarray) -> bytes:
    """Runs as columns, places as differences, so that the shuffle's compression finds the zeros."""
    found = found[np.lexsort((found["s0"], found["doc"]))]
    planes = lambda x, n: np.ascontiguousarray(x).view(np.uint8).reshape(-1, n).T.tobytes()
    fp = found["fp"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    hashes = (found[k].astype("<u8").tobytes() for k in ("sh", "s2"))
    return b"".join((fp, *hashes, planes(np.diff(found["doc"], prepend=0).astype("<i8"), 8), planes(found["s0"].astype("<i4"), 4), planes(found["n"].astype("<i4"), 4)))


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // _WIDTH
    raw = np.frombuffer(blob, np.uint8)
    out = np.zeros(n, _RUN)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = raw[: 6 * n].reshape(n, 6)
    out["fp"] = wide.view("<u8").ravel()
    out["sh"], out["s2"] = (raw[a * n : (a + 8) * n].copy().view("<u8") for a in (6, 14))
    out["doc"] = np.cumsum(np.ascontiguousarray(raw[22 * n : 30 * n].reshape(8, n).T).view("<i8").ravel())
    out["s0"] = np.ascontiguousarray(raw[30 * n : 34 * n].reshape(4, n).T).view("<i4").ravel()
    out["n"] = np.ascontiguousarray(raw[34 * n :].reshape(4, n).T).view("<i4").ravel()
    return out


REPEAT, RUNS, SLICES, WINDOWS = 0, 1, 2, 3
DEALT = "bucket int, kind int, doc long, first int, last int, blob binary"


def _rows(kind: int, bucket=None, doc=None, first=None, last=None, blobs=None) -> pa.RecordBatch:
    n = len(doc if blobs is None else blobs)
    whole = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32) if bucket is None else bucket, pa.int32()), pa.array(np.full(n, kind, np.int32)), whole(doc, pa.int64()), whole(first, pa.int32()), whole(last, pa.int32()), whole(blobs, pa.binary())],
        ["bucket", "kind", "doc", "first", "last", "blob"],
    )


def _repeats(later: np.ndarray) -> pa.RecordBatch:
    doc, lo, hi = joined(later)
    return _rows(REPEAT, (doc % 1024).astype(np.int32), doc, lo.astype(np.int32), hi.astype(np.int32))


def _dealt(found: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sum up equal runs and send the distinct ones to buckets, the later ones out as repeats."""
    first, later = summed(found)
    if len(later):
        yield _repeats(later)
    _, of, count = np.unique(first["fp"], return_inverse=True, return_counts=True)
    hot = count[of] > SPLIT
    if hot.any():  # their windows are dealt out one by one; a run without windows tells the bucket that others' must be as well
        split = first[hot]
        yield _rows(WINDOWS, (split["doc"] % 1024).astype(np.int32), split["doc"], split["s0"], split["s0"] + split["n"] - 1)
        told = np.unique(split["fp"])
        marks = np.zeros(len(told), _RUN)
        marks["fp"] = told
        first = np.concatenate((first[~hot], marks))
    if not len(first):
        return
    bucket = (mix(first["fp"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, bucket = first[order], bucket[order]
    names, at = np.unique(bucket, return_index=True)
    at = np.append(at, len(bucket))
    for lo in range(0, len(names), 256):
        part = range(lo, min(lo + 256, len(names)))
        yield _rows(RUNS, names[lo : lo + 256].astype(np.int32), blobs=[_pack(first[at[k] : at[k + 1]]) for k in part])


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part in pieces(batches, "text"):
            data, off = utf8(part.column("text"))
            held.append(runs(data, off, part.column("doc").to_numpy()))
            size += len(held[-1])
            if size >= FLUSH:
                yield from _dealt(np.concatenate(held), buckets)
                held, size = [], 0
        if held:
            yield from _dealt(np.concatenate(held), buckets)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, blobs of runs, blobs of slices) of rows sorted by bucket; repeats aren't among them."""
    now, runs_, slices = None, [], []
    for b in batches:
        for bucket, kind, blob in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if bucket != now:
                if now is not None:
                    yield now, runs_, slices
                now, runs_, slices = bucket, [], []
            (runs_ if kind == RUNS else slices).append(blob)
    if now is not None:
        yield now, runs_, slices


FOUND = "kind int, fp long, doc long, first int, last int"


def _found(kind: int, fp, doc, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(np.asarray(fp, np.int64)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(first, np.int32)), pa.array(np.asarray(last, np.int32))], ["kind", "fp", "doc", "first", "last"])


def _passing(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that belong to a bucket; repeats and windows to be dealt out go to `passed`."""
    for b in batches:
        kind = b.column("kind").to_numpy()
        for of, found in ((REPEAT, 0), (WINDOWS, 2)):
            if (kind == of).any():
                r = b.filter(pa.array(kind == of))
                passed.append(_found(found, np.zeros(r.num_rows), r.column("doc"), r.column("first"), r.column("last")))
        own = (kind != REPEAT) & (kind != WINDOWS)
        if own.any():
            yield b.filter(pa.array(own))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of runs: repeats (kind 0), and runs to compare byte by byte (1) or, of hot minimizers, by window (2)."""
    passed: list[pa.RecordBatch] = []
    for _, blobs, _ in _by_bucket(_passing(batches, passed)):
        yield from passed
        passed.clear()
        first, later = summed(np.concatenate([_unpack(b) for b in blobs]))
        split, first, later = np.unique(first["fp"][first["n"] == 0]), first[first["n"] > 0], later[later["n"] > 0]
        if len(later):
            doc, lo, hi = joined(later)
            yield _found(0, np.zeros(len(doc)), doc, lo, hi)
        if not len(first):
            continue
        _, inverse, count = np.unique(first["fp"], return_inverse=True, return_counts=True)
        count = count[inverse]
        hot = (count > HOT) | np.isin(first["fp"], split)
        for kind, chosen in ((1, first[(count > 1) & ~hot]), (2, first[hot])):
            if len(chosen):
                yield _found(kind, chosen["fp"].astype(np.int64), chosen["doc"], chosen["s0"], chosen["s0"] + chosen["n"] - 1)
    yield from passed


_SLICE = np.dtype([("doc", "<i8"), ("s0", "<i4"), ("n", "<i4")])


def _slices(buckets: int):
    """Fetch the bytes of wanted runs; split those of hot minimizers into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[np.ndarray] = []
        for part in pieces(batches, "text"):
            data, off = utf8(part.column("text"))
            want = part.column("want")
            n = np.diff(want.offsets.to_numpy())
            flat = want.flatten()
            owner = np.repeat(np.arange(part.num_rows), n)
            kind, fp, lo, hi = (flat.field(k).to_numpy() for k in ("kind", "fp", "first", "last"))
            inside = hi + LENGTH <= np.diff(off)[owner]  # a row that repeats an id with another text may be shorter
            kind, fp, lo, hi, owner = kind[inside], fp[inside], lo[inside].astype(np.int64), hi[inside].astype(np.int64), owner[inside]
            doc = part.column("doc").to_numpy()[owner]
            is_hot = kind == 2
            if is_hot.any():
                w = np.zeros(int((hi - lo + 1)[is_hot].sum()), _RUN)
                length = (hi - lo + 1)[is_hot]
                at = ranges(lo[is_hot], length)
                place = np.repeat(off[:-1][owner[is_hot]], length) + at
                for name, second in (("sh", False), ("s2", True)):
                    total, down = _sums(data, second)
                    w[name] = mix((total[place + LENGTH] - total[place]) * down[place])
                # windows of a minimizer meet those of the same bytes alone
                w["fp"] = mix(w["sh"] + w["s2"]) >> np.uint64(16)
                w["doc"], w["s0"], w["n"] = np.repeat(doc[is_hot], length), at, 1
                hot.append(w)
                if sum(map(len, hot)) > FLUSH:
                    yield from _dealt(np.concatenate(hot), buckets)
                    hot = []
            if not is_hot.all():
                cold = ~is_hot
                fp, lo, hi, doc, owner = fp[cold], lo[cold], hi[cold], doc[cold], owner[cold]
                bucket = (mix(fp.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                fp, lo, hi, doc, owner, bucket = (x[order] for x in (fp, lo, hi, doc, owner, bucket))
                size = hi - lo + LENGTH
                body = data[ranges(off[:-1][owner] + lo, size)]
                edge = np.concatenate(([0], np.cumsum(size)))
                head = np.zeros(len(lo), _SLICE)
                head["doc"], head["s0"], head["n"] = doc, lo, hi - lo + 1
                names, at = np.unique(bucket, return_index=True)
                at = np.append(at, len(bucket))
                blobs = [np.uint32(at[k + 1] - at[k]).tobytes() + head[at[k] : at[k + 1]].tobytes() + body[edge[at[k]] : edge[at[k + 1]]].tobytes() for k in range(len(names))]
                yield _rows(SLICES, names.astype(np.int32), blobs=blobs)
        if hot:
            yield from _dealt(np.concatenate(hot), buckets)

    return run


def _direct(window: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes from there on (8 at a time; only ties go deeper)."""
    key = window[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1 if len(at) else np.zeros(0, np.int64)
    for deep in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = window[at[tied] + deep]
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(tied), bool)
        inner[1:] = (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1])
        new[tied] |= inner
        group = np.cumsum(new) - 1
    return at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of text in order of their first `depth` bytes at least, sorted in two stages."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    window = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        window |= padded[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
    wide = text.astype(np.int16)
    step = np.append(np.sign(np.diff(wide)), -1)  # 1: the next byte is greater; the end is smaller than any byte
    known = np.flatnonzero(step)
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0  # than the successor; equal bytes take their type
    direct = _direct(window, np.flatnonzero(smaller), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    lists[text[-1]].append(np.array([n - 1], np.int64))
    out = []
    for c in range(256):
        induced, front = list(lists[c]), np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int64)
        while len(front):  # predecessors with the same byte come behind, in the same order
            front = front[front > 0] - 1
            front = front[text[front] == c]
            if len(front):
                induced.append(front)
        bucket = np.concatenate((*induced, direct[cut[c] : cut[c + 1]]))
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        values, at = np.unique(first, return_index=True)
        for v, part in zip(values.tolist(), np.split(before, at[1:]) if len(values) else (), strict=True):
            lists[v].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For each neighbour pair in order: how many bytes they share, up to limit."""
    padded = np.concatenate((text, np.zeros(limit, np.uint8)))
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(limit):
        live = live[(padded[a[live] + k] == padded[b[live] + k]) & (np.maximum(a[live], b[live]) + k < len(text))]
        if not len(live):
            break
        out[live] += 1
    return out


def repeated_windows(head: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Windows of slices that equal an earlier window, as runs of one; head: doc, s0 and number of windows of each."""
    size = head["n"].astype(np.int64) + LENGTH - 1
    place = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.uint8)
    text[ranges(place, size)] = body
    order = suffix_array(text)
    owner = np.full(len(text), -1, np.int64)
    starts = ranges(place, head["n"])
    owner[starts] = np.repeat(np.arange(len(head)), head["n"])
    order = order[owner[order] >= 0]  # others reach over a slice's end
    same = common_prefixes(text, order) >= LENGTH
    group = np.concatenate(([0], np.cumsum(~same)))
    own = owner[order]
    doc, start = head["doc"][own], head["s0"][own] + order - place[own]
    rank = np.lexsort((start, doc, group))
    group, doc, start = group[rank], doc[rank], start[rank]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ((doc != doc[lead]) | (start != start[lead]))
    out = np.zeros(int(later.sum()), _RUN)
    out["doc"], out["s0"], out["n"] = doc[later], start[later], 1
    return out


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    passed: list[pa.RecordBatch] = []
    for _, hot, slices in _by_bucket(_passing(batches, passed)):
        yield from passed
        passed.clear()
        later = []
        if hot:
            later.append(summed(np.concatenate([_unpack(b) for b in hot]))[1])
        if slices:
            heads, bodies = [], []
            for blob in slices:
                n = int(np.frombuffer(blob, np.uint32, 1)[0])
                heads.append(np.frombuffer(blob, _SLICE, n, 4))
                bodies.append(np.frombuffer(blob, np.uint8, offset=4 + n * _SLICE.itemsize))
            later.append(repeated_windows(np.concatenate(heads), np.concatenate(bodies)))
        doc, lo, hi = joined(np.concatenate(later))
        if len(doc):
            yield _found(0, np.zeros(len(doc)), doc, lo, hi)
    yield from passed


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): per document with any, [first, last] of the starts of windows that also start earlier."""
    spark = docs.sparkSession
    parts = n_partitions(spark)
    buckets = max(1024, 16 * parts)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH))
    dealt = map_arrow(rows, _cut(buckets), DEALT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = as_table(map_arrow(dealt, _met, FOUND), "met")
    want = found.where("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "fp", "first", "last")).alias("want"))
    fetched = map_arrow(rows.join(want, "doc"), _slices(buckets), DEALT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    more = as_table(map_arrow(fetched, _sorted, FOUND), "sorted")
    return found.where("kind = 0").union(more).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(n: int, spans) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes under the windows that start in the spans."""
    starts, ends = [], []
    for lo, hi in sorted(spans):
        hi = min(hi + LENGTH, n)
        if lo >= n:
            continue
        if ends and lo <= ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return starts, ends


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the spans as last column, whatever names the others have."""
    doc, spans = fresh("doc"), fresh("spans")
    found = repeats(docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("spans").alias(spans))
    return docs.join(found, F.col(id_col).cast("long") == F.col(doc), "left").drop(doc)


def _spans(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    off = column.offsets.to_numpy()
    flat = column.values
    lo, hi = flat.field("first").to_pylist(), flat.field("last").to_pylist()
    for k in range(len(column)):
        yield list(zip(lo[off[k] : off[k + 1]], hi[off[k] : off[k + 1]], strict=True))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        data, off = utf8(part.column("text"))
        raw = memoryview(data)
        out = []
        for k, spans in enumerate(_spans(part.columns[-1])):
            own = raw[off[k] : off[k + 1]]
            starts, ends = covered(len(own), spans)
            sha, at = hashlib.sha256(), 0
            for a, b in zip(starts, ends, strict=True):
                sha.update(own[at:a])
                at = b
            sha.update(own[at:])
            out.append((len(own), sum(ends) - sum(starts), len(starts), sha.hexdigest()))
        if out:
            n, removed, spans, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(_with_spans(rows, "id", "text"), _digests, DIGEST)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of the text. A character that is removed in part stays whole; a row whose
    text is removed altogether goes."""
    joined_ = _with_spans(docs, id_col, text_col)
    at = joined_.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col):
            data, off = utf8(part.column(text_col))
            texts, keep = part.column(text_col).to_pylist(), np.ones(part.num_rows, bool)
            for k, spans in enumerate(_spans(part.columns[-1])):
                if not spans:
                    continue
                own = data[off[k] : off[k + 1]]
                lead = np.append((own & 0xC0) != 0x80, True)  # where a character may start
                left, done = [], 0
                for a, b in zip(*covered(len(own), spans), strict=True):
                    while not lead[a]:
                        a += 1
                    while not lead[b]:
                        b -= 1
                    if a < b:
                        left.append(own[done:a].tobytes())
                        done = b
                left.append(own[done:].tobytes())
                texts[k] = b"".join(left).decode()
                keep[k] = bool(texts[k])
            columns = part.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1]).filter(pa.array(keep))

    return map_arrow(joined_, run, docs.schema)
