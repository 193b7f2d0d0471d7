"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a whitespace marker after another character, no merge crosses from a character to a
marker. A text then falls into chunks (markers, then other characters) whose segmentations do not depend on each other:
each distinct chunk is segmented once and its ids are joined back by position. The table lives in a task and is emptied
between batches when it would hold more than `TABLE_ROWS` chunks; only a batch with more distinct chunks than that of its
own (one long text) exceeds it until the next. A model that breaks the condition, or normalises other characters, is refused.

Defined results: null text is encoded like an empty one (the end id alone); ids of rows stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import map_arrow, pieces

MARK = "▁"
TABLE_ROWS = 250_000
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class ChunkTable:
    """Segments texts by distinct chunks; `encode(text)` returns (ids as text, number of ids, decoded text)."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in names if not p.startswith("<")):
            raise ValueError("a piece of this model crosses a whitespace marker")
        probe = " Åﬁ  x "
        if self.sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model normalises more than blanks")
        self.mark_id = self.sp.piece_to_id(MARK)
        self.end = self.sp.eos_id()
        self.known: dict[str, tuple[str, str]] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Add chunks that begin with a marker; the library adds the first marker itself."""
        many = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, ids in zip(chunks, many, strict=True):
            if not ids:  # a lone marker
                ids = [self.mark_id]
            # decode drops the marker at the very beginning; a leading lone marker keeps that of the chunk
            self.known[chunk] = (" ".join(map(str, ids)), self.sp.decode([self.mark_id, *ids]), len(ids))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        split = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = dict.fromkeys(c for chunks in split for c in chunks)
        fresh = [c for c in missing if c not in self.known]
        if len(self.known) + len(fresh) > TABLE_ROWS:
            self.known.clear()
            fresh = list(missing)
        if fresh:
            self._segment(fresh)
        known = self.known
        for chunks in split:
            rows = [known[c] for c in chunks]
            ids = [r[0] for r in rows]
            ids.append(str(self.end))
            text = "".join([r[1] for r in rows])
            yield " ".join(ids), sum([r[2] for r in rows]) + 1, text[1:]


def _digester(model_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        sha = hashlib.sha256
        for part in pieces(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = [(n, sha(ids.encode()).hexdigest(), sha(text.encode()).hexdigest()) for ids, n, text in table.encode_batch(texts)]
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    return map_arrow(_rows(docs, id_col, text_col), _digester(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_rows(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` (with the end id) and `decoded` (the text they decode to) in place of the text."""
    others = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for part in pieces(batches, text_col):
            rows = [(np.fromstring(ids, np.int32, sep=" "), text) for ids, _, text in table.encode_batch([t or "" for t in part.column(text_col).to_pylist()])]
            ids, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(ids, pa.list_(pa.int32())), pa.array(text)], [*others, "ids", "decoded"])

    kept = docs.select(*others, F.col(text_col).cast("string").alias(text_col))
    schema = kept.drop(text_col).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return map_arrow(kept, run, schema)
