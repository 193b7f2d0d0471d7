"""The corpus operators against brute force on a small table with hard rows: nulls, empty and long texts, copies, near
copies, repeated rows, shared passages, columns whose names clash with the operators' own."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import lines, media, mixing, neardup, pieces, queries, ridge, sharding, suffix, topk, toxicity
from gleanery.llm.common import crc
from gleanery.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, mix_copies int, removed_spans int, _id long, ids int, decoded string, want string"


def make(seed=3):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    texts: list[str | None] = [None, "", "   ", "one", "One two", "ﬁ Å 🎉 ▁ x\x00y <s> \t\n", "  a  b ", "a" * 350, "ab " * 400]
    base = [sentence(60) + "\n" + sentence(40) for _ in range(12)]
    passage = " ".join(sentence(14) for _ in range(4))
    texts += base
    texts += [base[0], base[0], base[1].upper()]
    for k in range(24):  # near copies of one text, more than a list holds pairs for
        w = base[2].split(" ")
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(k)
        texts.append(" ".join(w))
    for k in range(40):
        w = base[3].split(" ")
        for _ in range(1 + k % 12):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(k) + "x"
        texts.append(" ".join(w))
    texts += [sentence(10) + " " + passage + " " + sentence(9) for _ in range(5)]
    texts += [sentence(5000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i], "en", None if k % 7 == 0 else f"s{k % 3}", 0) for k, i in enumerate(order)]
    rows += [(None, base[4], None, None, None), (rows[5][0], *rows[5][1:])]
    return [(*r, 1, "s", 2, 3, 4, 5, "d", "w") for r in rows]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}


def test_media(docs, empty):
    got = media.media_digests(docs).collect()
    assert len(got) == len(ROWS) and media.media_digests(empty).count() == 0
    for r in got:
        if r["doc_id"] is None:
            continue
        b = TEXTS[r["doc_id"]].encode()
        payload = b + b" " * (-len(b) % 192 or (192 if not b else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    clips = media.clips(media.to_media(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))).collect()
    by = defaultdict(list)
    for c in clips:
        by[c["id"]].append(c)
    assert set(by) == set(TEXTS)
    for i, cs in by.items():
        cs.sort(key=lambda c: c["clip"])
        assert [c["clip"] for c in cs] == list(range(len(cs))) and cs[0]["start_us"] == 0 and all(a["end_us"] == b["start_us"] for a, b in zip(cs, cs[1:], strict=False))
        assert sum(c["n_frames"] for c in cs) == max(1, -(-len(TEXTS[i].encode()) // 192))


def test_media_reads_only_what_it_knows():
    good = media.encode(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0]
    without_index = good[: good.index(b"idx1")]
    without_index = without_index[:4] + (len(without_index) - 8).to_bytes(4, "little") + without_index[8:]
    assert media.decode([without_index])[0] == media.decode([good])[0] == [b"abc" + b" " * 189]
    with pytest.raises(media.MediaError):
        media.decode([b"RIFFxxxxWAVE"])


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert pieces.token_digests(empty, queries.piece_model()).count() == 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in pieces.token_digests(docs, queries.piece_model()).where("doc_id is not null").collect():
        ids = sp.encode(TEXTS[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    for r in pieces.encode_rows(docs, queries.piece_model()).where("doc_id is not null").collect():
        assert r["ids"] == sp.encode(TEXTS[r["doc_id"]], add_eos=True) and r["decoded"] == sp.decode(r["ids"]) and r["spans"] == "s"


def test_pieces_table_overflow(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 3)
    t = pieces.ChunkTable(queries.piece_model())
    texts = ["a b c d e f", "x  y z", "a"]
    got = [(g[0], g[2]) for s in texts for g in t.encode_batch([s])]
    assert got == [(" ".join(map(str, t.sp.encode(s, add_eos=True))), s) for s in texts]


def test_sharding(docs, empty):
    got = sharding.shards(docs, 4).collect()
    assert len(got) == len(ROWS) and sharding.shards(empty, 4).count() == 0
    slots, loads, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            b = TEXTS[r["doc_id"]].encode()
            assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "bytes" and r["grown_shard"] is None
            groups[b].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    largest = max(sum(r["size"] for r in got if r["doc_id"] in TEXTS and TEXTS[r["doc_id"]] == t) for t in set(TEXTS.values()))
    assert max(loads.values()) - min(loads.values()) <= largest


def test_longest_first():
    assert sharding.longest_first([(1, 5), (2, 4), (3, 3), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(40):
        n, letters = rng.choice([1, 2, 5, 60, 700]), rng.choice([2, 3, 250])
        x = np.array([rng.randrange(1, letters + 1) for _ in range(n)], np.uint8)
        x = np.tile(x[: max(1, n // 5)], 6)[:n] if rng.random() < 0.3 else x
        b = x.tobytes()
        keys = [b[i : i + 100] for i in suffix.suffix_array(x)]
        assert sorted(suffix.suffix_array(x).tolist()) == list(range(n)) and keys == sorted(keys)


def brute_suffix(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix(docs, empty, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)  # also the way of hot minimizers
    want = brute_suffix(TEXTS)
    got = suffix.dedup_digests(docs).where("doc_id is not null").collect()
    assert len(got) == len(ROWS) - 1 and suffix.dedup_digests(empty).count() == 0
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]][:4] for r in got)
    left = suffix.without_repeats(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.where("doc_id is not null").collect()}
    for i, t in TEXTS.items():
        kept = want[i][4]
        if want[i][1] == 0:
            assert (texts[i] or "") == t
        elif kept.isascii():
            assert texts.get(i, "") == kept.decode()


def brute_sets(size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, empty, size, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 6)  # the large lists' way too
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    sets = brute_sets(size)
    want = brute_components(sets)
    rows = neardup.near_duplicates(docs, size).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    if size == 5:
        kept = neardup.keep_first(docs, size)
        ids = [r["doc_id"] for r in kept.collect()]
        assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i) and ids.count(None) == 1
        assert neardup.near_duplicates(empty, size).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 100), (5, 5), (200, 201), (201, 202)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 100: 90, 201: 200, 202: 200}


def test_lines(docs, empty):
    got = {(r["doc_id"], r["unit"], r["start"], r["end"], r["keep_doc_id"], r["keep_unit"]) for r in lines.repeated_units(docs).where("doc_id is not null").collect()}
    seen, want = {}, set()
    for i, t in sorted(TEXTS.items()):
        for k, m in enumerate(re.finditer(lines.SENTENCE, t)):
            words = re.findall(r"[^ \t\r\n\x0b\x0c]+", m[0].lower())
            if len(words) >= lines.LEAST_WORDS:
                key = " ".join(words)
                if key in seen:
                    want.add((i, k, m.start(), m.end(), *seen[key]))
                else:
                    seen[key] = (i, k)
    assert got == want and want and lines.repeated_units(empty).count() == 0
    left = lines.without_units(docs, lines.repeated_units(docs))
    assert set(left.columns) == set(docs.columns)
    spans = defaultdict(list)
    for i, _, a, b, *_ in want:
        spans[i].append((a, b))
    for r in left.where("doc_id is not null").select("doc_id", "text").collect():
        t = TEXTS[r["doc_id"]]
        for a, b in sorted(spans[r["doc_id"]], reverse=True):
            t = t[:a] + t[b:]
        assert (r["text"] or "") == t


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 8), (260, [float("inf")] * 8), (280, [1.0, 2.0]), (None, [1.0] * 8), (300, []), (320, rows[0][1]), (321, rows[0][1]), (322, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, [1], 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, x array<int>, norm double")
    good = [(i, np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    got = topk.top_k(df, F.pmod(F.col("id"), F.lit(20)) == 0, 20).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_large_numbers():
    q = np.array([[2**30, 1], [3, 4]], np.int64)
    x = np.array([[2**30, 5], [1, 1]], np.int64)
    i, j = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    assert topk.scored(q, x, i, j).tolist() == [2**60 + 5, 2**30 + 1, 3 * 2**30 + 20, 7]


def test_mixing(docs, empty, monkeypatch):
    one = mixing.mix(docs, temperature=0.5)
    rows = [(r["doc_id"], r["mix_copy"], r["mix_copies"], r["mix_rate"], r["mix_place"], r["text"], r["source"]) for r in one.collect()]
    assert rows and mixing.mix(empty).count() == 0
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3] or ""] += len(r[1] or "")
    total = sum(sizes.values())
    shares = {s: v**0.5 for s, v in sizes.items()}
    for i, copy, copies, rate, place, _, source in rows:
        assert 0 <= copy < copies and rate == pytest.approx(shares[source or ""] / sum(shares.values()) * total / sizes[source or ""])
        u = int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        p = below = np.exp(-rate)
        k = 0
        while u >= below:
            k += 1
            p *= rate / k
            below += p
        assert k == copies and 0 <= place < 1
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = [(r["doc_id"], r["mix_copy"], r["mix_copies"]) for r in mixing.mix(docs, temperature=0.5).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(salted, key=key) == sorted((r[:3] for r in rows), key=key)
    only = {r["source"] for r in mixing.mix(docs, weights={"s1": 1.0}).collect()}
    assert only <= {"s1"}


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.4
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["numbskull", "wretch", "vile"])
        text = " ".join(x.upper() + "!!" if junk else x for x in w) + "."
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "x")]
    labels += [(0, None, None), (None, 1, 1), (9999, 1, 1), (1, labels[1][1], labels[1][2])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:600]}


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers(spark, which):
    docs, labels, truth = labelled(spark)
    mod, rem = (5, 0) if which == "quality" else (3, 1)
    held_out = F.pmod(crc("doc_id"), F.lit(mod)) == rem
    run = ridge.quality_scores if which == "quality" else toxicity.toxicity_scores
    got = run(docs, labels, held_out).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    again = {r["doc_id"]: r["score"] for r in run(docs.repartition(5), labels, held_out).collect()}
    right = n = 0
    for r in got:
        assert again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6)
        if r["doc_id"] in truth:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rem)
            if r["held_out"]:
                n += 1
                right += r["predicted"] == truth[r["doc_id"]][which == "toxic"]
    assert n > 90 and right / n > 0.95
    # nothing of the held-out labels is learnt
    flipped = labels.withColumn(which, F.when(held_out, 1 - F.col(which)).otherwise(F.col(which)))
    assert {r["doc_id"]: r["predicted"] for r in run(docs, flipped, held_out).collect()} == {r["doc_id"]: r["predicted"] for r in got}
    none = run(docs, labels.where("false"), held_out).collect()
    assert len(none) == 603 and run(docs.limit(0), labels, held_out).count() == 0


def test_grammar():
    g = toxicity.Grammar({"vile": 4.0}, {"numb": 3.0})
    clause = lambda s: g.features([s])[0, 2]
    assert clause("You are vile.") > clause("That is vile.") > clause("They are gone and nothing is here, but not vile.") > 0
    assert clause("He said that vile word.") < clause("That one vile word.") and clause("Fine words.") == 0 and clause("numbskull") > 0


def test_pooled():
    at, level = ridge.pooled(np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert at.tolist() == [1, 2.5, 4] and level.tolist() == [0, 0.5, 1]
