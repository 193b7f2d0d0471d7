"""Media columns: texts stored as AVI motion-JPEG, read back through the RIFF index.

Each payload byte is the DC coefficient of one flat 8 x 8 block (quantiser 8), so any baseline decoder shows the byte as
the grey of that block and the storing is lossless. A frame is 16 x 12 blocks (192 bytes, 128 x 96 pixels), an intra
frame with its own tables. Reading walks the RIFF chunks, takes frames from idx1, parses the JPEG segments, decodes the
Huffman data of many frames in step, and finds shots where the grey histogram changes more than its neighbourhood does.

Defined results: null text is stored like an empty one (192 blanks); equal texts give equal media; rows keep their id,
whatever else the table has; null ids stay null. RIFF holds sizes of 32 bits: a text whose media would pass 4 GiB (over 1 GB)
is refused with an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_arrow, pieces, ranges, utf8

UNIT = 192
COLS, ROWS = 16, 12
FPS = 25
BINS = 16
#: Fixed values of the JPEG standard: the usual luminance DC code lengths (codes of 2 to 9 bits for categories 0 to 11).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The AC table has one symbol, end of block, as a code of one bit.
AC_COUNTS = (1, *(0,) * 15)
AC_SYMBOLS = (0,)


def codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code they begin with; 0 where there is none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header() -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, COLS * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_head(frames: int) -> bytes:
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, COLS * 8, ROWS * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, COLS * 8, ROWS * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, COLS * 8, ROWS * 8, 1, 24, b"MJPG", COLS * ROWS * 192, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl))


def _diff_table() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits of DC code, amplitude and end of block, and how many."""
    dc, (eob, eob_len) = codes(DC_COUNTS, DC_SYMBOLS), codes(AC_COUNTS, AC_SYMBOLS)[0]
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = dc[cat]
        amplitude = d if d >= 0 else d + (1 << cat) - 1
        value[d + 255] = (((code << cat) | amplitude) << eob_len) | eob
        length[d + 255] = n + cat + eob_len
    return value, length


def payloads(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with blanks to a positive multiple of UNIT bytes, and their offsets."""
    n = np.diff(off)
    size = np.maximum(1, -(-n // UNIT)) * UNIT
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), 32, np.uint8)
    out[ranges(at[:-1], n)] = data
    return out, at


def encode(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """One AVI file for each text."""
    body, at = payloads(data, off)
    samples = body.reshape(-1, UNIT).astype(np.int64)
    frames = len(samples)
    diff = np.diff(samples, axis=1, prepend=128)
    value, length = _diff_table()
    bits, lens = value[diff + 255], length[diff + 255]
    end = np.cumsum(lens, axis=1)
    n_bytes = (end[:, -1] + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    pos = (base[:, None] * 8 + end - lens).ravel()
    word = bits.ravel() << (24 - lens.ravel() - (pos & 7))
    first, total = pos >> 3, int(n_bytes.sum())
    entropy = np.zeros(total + 3, np.float64)
    for k in range(3):
        entropy[k : total + k] += np.bincount(first, weights=(word >> (16 - 8 * k)) & 255, minlength=total)[:total]
    entropy = entropy[:total].astype(np.uint8)
    entropy[base + n_bytes - 1] |= ((1 << (n_bytes * 8 - end[:, -1])) - 1).astype(np.uint8)
    full = entropy == 255
    copies = 1 + full
    stuffed = np.repeat(entropy, copies)
    stuffed[np.cumsum(copies)[full] - 1] = 0
    n_stuffed = n_bytes + np.add.reduceat(full.astype(np.int64), base)
    head = np.frombuffer(b"00dc\0\0\0\0" + jpeg_header(), np.uint8)
    size = len(head) - 8 + n_stuffed + 2
    span = 8 + size + (size & 1)
    start = np.cumsum(span) - span
    movi = np.zeros(int(span.sum()), np.uint8)
    movi[start[:, None] + np.arange(len(head))] = head
    movi[start[:, None] + np.arange(4, 8)] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    movi[ranges(start + len(head), n_stuffed)] = stuffed
    movi[start + len(head) + n_stuffed] = 0xFF
    movi[start + len(head) + n_stuffed + 1] = 0xD9
    index = np.zeros(frames, [("id", "S4"), ("flags", "<u4"), ("off", "<u4"), ("len", "<u4")])
    index["id"], index["flags"], index["len"] = b"00dc", 0x10, size
    out = []
    raw = movi.tobytes()
    edges = at // UNIT
    stops = np.concatenate((start, [len(raw)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        lo, hi = int(stops[a]), int(stops[b])
        if hi - lo + 16 * (b - a) > 0xFFFF0000:
            raise MediaError("a text is too long for RIFF's 32-bit sizes")
        index["off"][a:b] = start[a:b] - lo + 4
        rest = avi_head(b - a) + b"LIST" + struct.pack("<I", hi - lo + 4) + b"movi" + raw[lo:hi] + _chunk(b"idx1", index[a:b].tobytes())
        out.append(b"RIFF" + struct.pack("<I", len(rest) + 4) + b"AVI " + rest)
    return out


class MediaError(ValueError):
    """The bytes are not an AVI file of grey baseline intra frames."""


def riff(media: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Microseconds a frame, and offsets and sizes of the video frames, by idx1 or else by walking movi."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise MediaError("no RIFF AVI header")
    at, end, movi, index, micros = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), None, None, 0
    stack = []
    while at + 8 <= end or stack:
        if at + 8 > end:
            at, end = stack.pop()
            continue
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        after = at + 8 + size + (size & 1)
        if name == b"LIST":
            kind = media[at + 8 : at + 12]
            if kind == b"movi":
                movi = (at + 8, at + 8 + size)
            elif kind == b"hdrl":
                stack.append((after, end))
                at, end = at + 12, at + 8 + size
                continue
        elif name == b"avih":
            micros = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"idx1":
            index = np.frombuffer(media, [("id", "S4"), ("flags", "<u4"), ("off", "<u4"), ("len", "<u4")], size // 16, at + 8)
        at = after
    if movi is None:
        raise MediaError("no movi list")
    if index is not None:
        index = index[index["id"] == b"00dc"]
        return micros, index["off"].astype(np.int64) + movi[0] + 8, index["len"].astype(np.int64)
    offs, sizes, at = [], [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"00dc":
            offs.append(at + 8)
            sizes.append(size)
        at += 8 + size + (size & 1)
    return micros, np.array(offs, np.int64), np.array(sizes, np.int64)


def jpeg_tables(frame: bytes) -> dict:
    """Parse the segments of a frame up to its scan."""
    if frame[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    out, at = {"huff": {}, "quant": {}}, 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC0:
            depth, height, width, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise MediaError("only grey frames of 8 bits")
            out |= {"height": height, "width": width, "table": body[8]}
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDA:
            return out | {"dc": body[2] >> 4, "ac": body[2] & 15, "scan": at + 2 + size}
        elif 0xC1 <= marker <= 0xCF:
            raise MediaError("only baseline frames")
        at += 2 + size
    raise MediaError("no scan")


def decode_frames(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Grey of each block of frames of one geometry, decoded in step: an array (frames, blocks)."""
    if not len(start):
        return np.zeros((0, 0), np.uint8)
    first = raw[start[0] : start[0] + size[0]].tobytes()
    tables = jpeg_tables(first)
    scan = tables["scan"]
    head = np.frombuffer(first[:scan], np.uint8)
    same = size >= scan
    same[same] &= (raw[start[same][:, None] + np.arange(scan)] == head).all(axis=1)
    if not same.all():  # frames with other tables are decoded on their own
        a = decode_frames(raw, start[same], size[same])
        b = decode_frames(raw, start[~same], size[~same])
        if a.shape[1] != b.shape[1]:
            raise MediaError("frames differ in size")
        out = np.zeros((len(start), a.shape[1]), np.uint8)
        out[same], out[~same] = a, b
        return out
    body = raw[ranges(start + scan, size - scan)]
    edge = np.concatenate(([0], np.cumsum(size - scan)))
    stuffing = np.zeros(len(body), bool)
    stuffing[1:] = (body[1:] == 0) & (body[:-1] == 255)
    stuffing[edge[:-1]] = False
    kept = np.concatenate(([0], np.cumsum(~stuffing)))
    bits = kept[edge[:-1]] * 8
    limit = kept[edge[1:]] * 8
    body = np.concatenate((body[~stuffing], np.zeros(8, np.uint8))).astype(np.uint32)
    window = body[:-3] << 24 | body[1:-2] << 16 | body[2:-1] << 8 | body[3:]
    dc, ac = lookup(*tables["huff"][tables["dc"]]), lookup(*tables["huff"][0x10 | tables["ac"]])
    step = int(tables["quant"][tables["table"]][0])
    blocks = -(-tables["height"] // 8) * (-(-tables["width"] // 8))
    out = np.zeros((blocks, len(start)), np.int32)
    last = np.zeros(len(start), np.int64)
    for k in range(blocks):
        w = (window[bits >> 3] << (bits & 7).astype(np.uint32)).astype(np.uint32)
        hit = dc[w >> 16]
        cat, n = (hit & 255).astype(np.int64), (hit >> 8).astype(np.int64)
        if not n.all():
            raise MediaError("no such DC code")
        extra = (w.astype(np.int64) >> (32 - n - cat)) & ((1 << cat) - 1)
        last = last + np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
        bits = bits + n + cat
        out[k] = last
        lanes, coefficient = np.arange(len(start)), np.ones(len(start), np.int64)
        while len(lanes):  # AC symbols up to the end of block; only the DC is kept
            at = bits[lanes]
            hit = ac[((window[at >> 3] << (at & 7).astype(np.uint32)).astype(np.uint32)) >> 16]
            if not hit.all():
                raise MediaError("no such AC code")
            symbol = hit & 255
            bits[lanes] = at + (hit >> 8) + (symbol & 15)
            if not symbol.any():
                break
            coefficient = coefficient + (symbol >> 4) + 1
            more = (symbol != 0) & (coefficient < 64)
            lanes, coefficient = lanes[more], coefficient[more]
        if (bits > limit).any():
            raise MediaError("a scan ends early")
    return np.clip((out.T * step + 4) // 8 + 128, 0, 255).astype(np.uint8)


def shots(hist: np.ndarray, first: np.ndarray, window: int = 4, least: int = UNIT // 8) -> np.ndarray:
    """True where a shot begins: a document's first frame, and frames whose histogram differs from the one before by
    `least` samples and by over 1.5 times the mean difference of up to `window` frames on either side."""
    n = len(hist)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) // 2
    diff[first] = 0
    doc = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    at = np.arange(n)
    lo, hi = np.maximum(begin[doc] + 1, at - window), np.minimum(end[doc], at + window + 1)
    total = np.concatenate(([0], np.cumsum(diff)))
    around, count = total[hi] - total[np.minimum(lo, hi)] - diff, hi - lo - 1
    return first | ((diff >= least) & (2 * diff * np.maximum(count, 1) > 3 * around))


def decode(media: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Payloads read back; then for all frames: which file, whether a shot begins, and microseconds a frame (by file)."""
    parsed = [riff(m) for m in media]
    raw = np.frombuffer(b"".join(media), np.uint8)
    base = np.cumsum([0, *map(len, media)])
    counts = np.array([len(p[1]) for p in parsed], np.int64)
    start = np.concatenate([p[1] + b for p, b in zip(parsed, base, strict=False)]) if media else np.zeros(0, np.int64)
    size = np.concatenate([p[2] for p in parsed]) if media else np.zeros(0, np.int64)
    grey = decode_frames(raw, start, size)
    edge = np.concatenate(([0], np.cumsum(counts)))
    out = [grey[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    owner = np.repeat(np.arange(len(media)), counts)
    lane = np.repeat(np.arange(len(grey), dtype=np.int64), grey.shape[1])
    hist = np.bincount(lane * BINS + (grey.ravel() >> 4), minlength=len(grey) * BINS).reshape(-1, BINS).astype(np.int64)
    first = np.zeros(len(grey), bool)
    first[edge[:-1][counts > 0]] = True
    return out, owner, shots(hist, first), np.array([p[0] for p in parsed], np.int64)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        media = encode(*utf8(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], ["id", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as an AVI file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _encoded, "id long, media binary")


CLIPS = "id long, clip long, first_frame long, n_frames long, start_us long, end_us long, error string"


def _file_clips(ids: list, media: list[bytes]) -> list[tuple]:
    _, owner, begins, micros = decode(media)
    at = np.flatnonzero(begins)
    end = np.append(at[1:], len(owner))
    base = np.searchsorted(owner, np.arange(len(ids)))
    rows, clip, before = [], 0, -1
    for a, b in zip(at.tolist(), end.tolist(), strict=True):
        k = int(owner[a])
        clip, before = (clip + 1 if k == before else 0), k
        first, us = a - int(base[k]), int(micros[k])
        rows.append((ids[k], clip, first, b - a, first * us, (first + b - a) * us, None))
    return rows


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CLIPS.split(", ")]
    for part in pieces(batches, "media", 4 << 20):
        ids, media = part.column("id").to_pylist(), part.column("media").to_pylist()
        try:
            rows = _file_clips(ids, media)
        except (MediaError, struct.error, IndexError, KeyError, ValueError):  # a file can't be read with the others: one by one
            rows = []
            for i, m in zip(ids, media, strict=True):
                try:
                    rows += _file_clips([i], [m])
                except (MediaError, struct.error, IndexError, KeyError, ValueError) as e:
                    rows.append((i, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "error" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of (id, media) rows, one for each shot. A file that can't be read has one row with its `error` and no
    clip; null media have none. Files of a table may differ in frame size, frames of a file may not."""
    present = media.select("id", "media").where(F.col("media").isNotNull())
    return map_arrow(present, _clips, CLIPS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in DIGEST.split(", ")]
    for part in pieces(batches, "text"):
        data, off = utf8(part.column("text"))
        media = encode(data, off)
        payload, owner, begins, micros = decode(media)
        n_frames = np.bincount(owner, minlength=len(media)).tolist()
        base = np.concatenate(([0], np.cumsum(n_frames)))
        cuts = np.flatnonzero(begins)
        cut_owner = owner[cuts]
        edge = np.searchsorted(cut_owner, np.arange(len(media) + 1))
        rows = []
        for k, (m, p, i) in enumerate(zip(media, payload, part.column("id").to_pylist(), strict=True)):
            at = (cuts[edge[k] : edge[k + 1]] - base[k]).tolist()
            feature = f"frames={n_frames[k]};us={micros[k]};mean={sum(memoryview(p)) // len(p) if len(p) < 4096 else int(np.frombuffer(p, np.uint8).mean())};shots={','.join(map(str, at))}"
            rows.append((i, int(off[k + 1] - off[k]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, n_frames[k], len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as AVI, read the stored bytes back and return digests and shot features of what was read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _digests, DIGEST)
