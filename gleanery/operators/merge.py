"""Upserts, deletes and watermarks over index tables. A table holds one row for each id, across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str | list[str] = "id", *order: Column) -> DataFrame:
    """One row for each key: the first by the order given (say, the highest sequence number)."""
    keys = [key] if isinstance(key, str) else key
    order = order or (F.desc("seq"),)
    return changes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_by_max(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """As latest by falling seq, summed up before the shuffle: for hot keys and rows that are not wide."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in rest)).select(*changes.columns)


def upserted(base: DataFrame, changes: DataFrame, key: str = "id", op: str = "op") -> DataFrame:
    """base with changes applied: 'index' rows replace those of their id, 'delete' rows take them out. One change an id."""
    kept = base.join(changes.select(key), key, "left_anti")
    rows = changes.where(F.col(op) == "index").select(*base.columns)
    return kept.select(*base.columns).unionByName(rows)


def without_unseen(base: DataFrame, seen: DataFrame, source: str | None = None, key: str = "id", source_col: str = "source") -> DataFrame:
    """base without the rows (of one source) whose id a run has not seen."""
    if source is None:
        return base.join(seen.select(key), key, "left_semi")
    own = F.col(source_col).eqNullSafe(F.lit(source))
    return base.where(~own).unionByName(base.where(own).join(seen.select(key), key, "left_semi").select(*base.columns))


def unseen(base: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """The rows of base that a run has not seen."""
    return base.join(seen.select(key), key, "left_anti")


def seen_ids(documents: DataFrame, key: str = "identifier", deleted: str | None = None) -> DataFrame:
    """Distinct ids of a run; with `deleted`, only of rows that are not tombstones."""
    rows = documents.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else documents
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()


def watermark(documents: DataFrame, changed: str = "datestamp", old=None) -> Column | None:
    """The latest date seen, never before the old watermark."""
    return documents.agg(F.max(changed).alias("w")).select(F.greatest("w", F.lit(old).cast("timestamp")).alias("w")).first()["w"]


def counters(changes: DataFrame, op: str = "op") -> DataFrame:
    return changes.groupBy(op).agg(F.count("*").alias("n"))
