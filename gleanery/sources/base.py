"""What a source gives to a run, and how sources are opened by kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.evaluate import RAW
from gleanery.plans.config import SourceSpec


@dataclass
class Scan:
    """Documents (columns of RAW at least) with what the run must know about them.

    incremental: late documents are left out by date. complete: all ids of the source are there, so unseen ones may go.
    only_live: tombstones don't count as seen. watermark: the new one, or a function that finds it after the run."""

    documents: DataFrame
    incremental: bool = True
    complete: bool = True
    only_live: bool = False
    watermark: datetime | Callable[[], datetime | None] | None = None


def raw(df: DataFrame, source: str | None = None) -> DataFrame:
    """df with exactly the columns of a raw document; absent ones are null."""
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in RAW.fields:
        if f.name == "source" and source is not None:
            columns.append(F.lit(source).alias("source"))
        elif f.name in have:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            columns.append((F.lit(False) if f.name == "deleted" else F.lit(0 if f.name == "seq" else None)).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def newest(documents: DataFrame) -> Callable[[], datetime | None]:
    """The latest date of all documents enumerated, found when asked for."""
    return lambda: documents.agg(F.max("datestamp")).first()[0]


def noop(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    """No documents; for sources that only get pushed changes."""
    return Scan(spark.createDataFrame([], RAW), complete=False)


#: kind -> module and function; `register` adds to them.
OPENERS: dict[str, str | Callable[..., Scan]] = {
    "directory": "gleanery.sources.files:directory",
    "zip": "gleanery.sources.files:archive",
    "crawl": "gleanery.sources.web:crawl_source",
    "oai": "gleanery.sources.oai:oai_source",
    "oai_static": "gleanery.sources.oai:static_source",
    "table": "gleanery.sources.tables:table_source",
    "legacy": "gleanery.sources.tables:legacy_source",
    "noop": noop,
}


def register(kind: str, opener: Callable[..., Scan]) -> None:
    """Make a function (spark, source, watermark) -> Scan available under a kind."""
    OPENERS[kind] = opener


def open_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None = None) -> Scan:
    """Open by kind, or by a name like package.module:function."""
    opener = OPENERS.get(source.kind, source.kind if ":" in source.kind else None)
    if opener is None:
        raise ValueError(f"source {source.id}: unknown kind {source.kind}")
    if isinstance(opener, str):
        module, name = opener.split(":")
        opener = getattr(import_module(module), name)
    return opener(spark, source, watermark)
