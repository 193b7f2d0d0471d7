"""Substring dedup by line or paragraph hashing.

Texts are cut into units: paragraphs, lines, or lines cut further at sentence ends (the default, which also finds passages
that begin or end within a line). Each unit is normalised (lower case, blanks folded) and digested. A digest's
earliest unit (least doc_id, then position) stays, every later one goes, and the offsets of what goes are those of the
original text. Digests that many units share are counted before they meet their units, in two ways: the few that hold at
least 1/HEAVY of all units (HEAVY at most, by arithmetic) are broadcast, the others are joined.

Units of fewer than `least_words` words stay, unless `whole_lines` is set: then such a unit is digested as a place in its
whole line, so that a line that stands earlier goes whatever the lengths of its sentences, and in languages without blanks
too. Units without words always stay. Units cover the whole text, their punctuation and line feeds too. With `whole_lines`
no unit may cross a line feed that another character follows (SENTENCE may, at '\\n!'; WITHIN_LINES doesn't).

Defined results: null and empty texts have no units; a unit repeated within a document goes too; rows that repeat an id
count as the same document, so that equal units at the same place of them are one; rows with a null id come last, each a
document of its own: of n that hold a unit first of all, n - 1 are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, fresh, map_arrow, pieces

HEAVY = 10_000
LEAST_WORDS = 8
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
WITHIN_LINES = r"[^.!?\n]*(?:[.!?]+\n*|\n+)|[^.!?\n]+"
LINE = r"[^\n]*\n|[^\n]+"
PARAGRAPH = r"(?:[^\n]|\n(?!\n))*\n\n+|(?:[^\n]|\n(?!\n))+"
WORD = re.compile(r"[^ \t\r\n\x0b\x0c]+")


def _lines(text: str, found: list[re.Match]) -> Iterator[tuple[int, int, int]]:
    """Ranges [i, j) of units that make up a line, with the line's start."""
    i = 0
    for j, m in enumerate(found, 1):
        if j == len(found) or m[0].endswith("\n"):
            yield i, j, found[i].start()
            i = j


def _cutter(pattern: str, least_words: int, whole_lines: bool):
    cut = re.compile(pattern)
    md5 = lambda words: hashlib.md5(" ".join(words).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            ids, unit, start, end, digest = [], [], [], [], []

            def add(i, k, m, key):
                ids.append(i)
                unit.append(k)
                start.append(m.start())
                end.append(m.end())
                digest.append(key)

            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = list(cut.finditer(text)) if text else []
                words = [WORD.findall(m[0].lower()) for m in found]
                for k, (m, w) in enumerate(zip(found, words, strict=True)):
                    if len(w) >= least_words:
                        add(i, k, m, md5(w).digest())
                for a, b, at in _lines(text, found) if whole_lines else ():
                    if any(0 < len(w) < least_words for w in words[a:b]):
                        line = md5(WORD.findall(text[at : found[b - 1].end()].lower())).hexdigest()
                        for place, k in enumerate([k for k in range(a, b) if words[k]]):
                            if len(words[k]) < least_words:
                                # a line feed is in no unit's words, so these digests meet no others
                                add(i, k, found[k], md5((line, "\n", str(place))).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(unit, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "unit", "start", "end", "digest"])

    return run


UNITS = "doc_id long, unit int, start int, end int, digest binary"


def units(docs: DataFrame, pattern: str = SENTENCE, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", whole_lines: bool = False) -> DataFrame:
    """(doc_id, unit, start, end, digest) of each unit with least_words words or more, and with whole_lines of each other
    one that has words; offsets count characters."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _cutter(pattern, least_words, whole_lines), UNITS)


def repeated_units(docs: DataFrame, pattern: str = SENTENCE, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", whole_lines: bool = False) -> DataFrame:
    """(doc_id, unit, start, end, keep_doc_id, keep_unit): each unit to remove, with the occurrence that stays."""
    cut = as_table(units(docs, pattern, least_words, id_col, text_col, whole_lines), "units")
    mine = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit", "start", F.when(F.col("doc_id").isNull(), F.col("end")).alias("end"))
    digests = as_table(cut.groupBy("digest").agg(F.count("*").alias("count"), F.min(mine).alias("first")).where("count > 1"), "digests")
    total, named = cut.agg(F.count("*"), F.count("doc_id")).first()
    bar = (total + HEAVY - 1) // HEAVY
    heavy = digests.where(F.col("count") >= bar)
    light = digests.where(F.col("count") < bar)
    rest = cut.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    hit = cut.join(F.broadcast(heavy), "digest").union(rest.join(light, "digest"))
    out = hit.where(mine != F.col("first")).select("doc_id", "unit", "start", "end", "first")
    if named < total:
        # rows with a null id stand at the same place where they are the first: all but one of them go as well
        tied = hit.where(F.col("doc_id").isNull() & (mine == F.col("first"))).groupBy("digest", "unit", "start", "end", "first").agg(F.count("*").cast("int").alias("n")).where("n > 1")
        tied = tied.select("unit", "start", "end", "first", F.explode(F.sequence(F.lit(2), "n")).alias("nth"))
        out = out.union(tied.select(F.lit(None).cast("long").alias("doc_id"), "unit", "start", "end", "first"))
    return out.select("doc_id", "unit", "start", "end", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.unit").alias("keep_unit"))


def without_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose text lacks the removed units, with `removed_spans` (a column of that name is replaced): their [start, end)
    in the original text.

    Rows that share an id share its spans; rows with a null id keep their texts, since nothing tells them apart."""
    name = fresh("id")
    spans = removed.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed_spans")).withColumnRenamed("doc_id", name)
    joined = docs.drop("removed_spans").join(spans, F.col(id_col).cast("long") == F.col(name), "left").drop(name)
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("removed_spans", k - 1)["end"])
    until = lambda k: F.when(k == F.size("removed_spans"), F.char_length(text_col)).otherwise(F.get("removed_spans", k)["start"])
    kept = F.transform(F.sequence(F.lit(0), F.size("removed_spans")), lambda k: F.substring(F.col(text_col), end(k) + 1, until(k) - end(k)))
    return joined.withColumn(text_col, F.when(F.col("removed_spans").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "")))
