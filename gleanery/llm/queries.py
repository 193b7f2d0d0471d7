"""The queries over this subpackage's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common, lines, media, mixing, neardup, pieces, ridge, sharding, suffix, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(common.crc("doc_id"), F.lit(5)) == 0
    return ridge.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_units(table(spark, sf_dir, "documents"), lines.WITHIN_LINES, whole_lines=True)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_digests(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, budget=1.0)
    return mixed.withColumn("mix_rate", F.round("mix_rate", 6))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(common.crc("doc_id"), F.lit(3)) == 1
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.7)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), piece_model())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n_shards=16)


QUERIES = {f.__name__: f for f in (op1_quality, op2_media, op3_lines, op4_top_k, op5_suffix, op6_near_duplicates, op7_mixing, op8_toxicity, op9_pieces, op10_sharding)}

#: Words of one blank each and lower case, as the line operator normalises units; offsets count from 0. Units of eight words
#: or more count by themselves, others by their whole line and their place among its units that have words.
OP3_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^.!?\n]*(?:[.!?]+\n*|\n+)|[^.!?\n]+') AS parts FROM documents WHERE text IS NOT NULL AND text <> ''
), piece AS (
  SELECT r, doc_id, unnest(parts) AS piece, unnest(range(len(parts))) AS unit FROM doc
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY r ORDER BY unit) AS "end", regexp_extract_all(lower(piece), '[^ \t\r\n\x0b\x0c]+') AS words,
         coalesce(sum(CASE WHEN ends_with(piece, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM piece
), lined AS (
  SELECT r, line, array_to_string(regexp_extract_all(lower(string_agg(piece, '' ORDER BY unit)), '[^ \t\r\n\x0b\x0c]+'), ' ') AS whole FROM placed GROUP BY r, line
), keyed AS (
  SELECT r, doc_id, unit, "end" - length(piece) AS start, "end",
         CASE WHEN len(words) >= 8 THEN array_to_string(words, ' ') ELSE whole || chr(10) || row_number() OVER (PARTITION BY r, line ORDER BY unit) END AS key
  FROM placed JOIN lined USING (r, line) WHERE len(words) > 0
), ranked AS (
  SELECT doc_id, unit, start, "end", dense_rank() OVER w AS place, first_value(doc_id) OVER w AS keep_doc_id, first_value(unit) OVER w AS keep_unit
  FROM keyed WINDOW w AS (PARTITION BY key ORDER BY doc_id NULLS LAST, unit, CASE WHEN doc_id IS NULL THEN "end" END, CASE WHEN doc_id IS NULL THEN r END)
)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", keep_doc_id, CAST(keep_unit AS INTEGER) AS keep_unit
FROM ranked WHERE place > 1
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP6_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM word
), shingle AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM pair WHERE 100 * c >= 80 * (n + m - c) UNION ALL SELECT y, x FROM pair WHERE 100 * c >= 80 * (n + m - c)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.root
), component AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE doc AS (
  SELECT *, coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS name, row_number() OVER () AS r FROM documents
), size AS (
  SELECT s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM doc GROUP BY s
), total AS (
  SELECT CAST(sum(CAST(round(pow(size, 0.5), 6) AS DECIMAL(30, 6))) AS DOUBLE) AS w, sum(size) AS size FROM size
), rate AS (
  SELECT s, CASE WHEN size.size > 0 THEN pow(size.size, 0.5) / total.w * total.size * 1.0 / size.size ELSE 0.0 END AS rate FROM size, total
), parted AS (
  SELECT s, rate, greatest(1, CAST(ceil(rate / 50.0) AS INTEGER)) AS parts, rate / greatest(1, CAST(ceil(rate / 50.0) AS INTEGER)) AS part_rate FROM rate
), law AS (
  SELECT s, part_rate, 0 AS k, exp(-part_rate) AS p, exp(-part_rate) AS below FROM parted WHERE rate > 0
  UNION ALL SELECT s, part_rate, k + 1, p * part_rate / (k + 1), below + p * part_rate / (k + 1) FROM law WHERE k < 164
), part AS (
  SELECT r, s, name, unnest(range(parts)) AS part FROM doc JOIN parted USING (s)
), drawn AS (
  SELECT r, s, CAST('0x' || substr(md5('mix|' || CASE WHEN part = 0 THEN '' ELSE 'part|' || part || '|' END || name), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM part
), counted AS (
  SELECT r, sum(copies) AS copies FROM (SELECT r, (SELECT count(*) FROM law WHERE law.s = d.s AND d.u >= law.below) AS copies FROM drawn d) GROUP BY r
), copy AS (
  SELECT doc.*, parted.rate, copies, unnest(range(CAST(copies AS BIGINT))) AS copy FROM doc JOIN counted USING (r) JOIN parted USING (s)
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, CAST(copies AS INTEGER) AS mix_copies, CAST(copy AS INTEGER) AS mix_copy,
  CAST('0x' || substr(md5('mix|place|' || name || '|' || copy), 1, 13) AS BIGINT) / 4503599627370496.0 AS mix_place
FROM copy
"""

ORACLE_SQL: dict[str, str] = {"op3_lines": OP3_SQL, "op4_top_k": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op7_mixing": OP7_SQL}
