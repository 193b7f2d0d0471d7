"""Directories and ZIP archives of XML files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.verdict import named_like, outdated
from gleanery.plans.config import SourceSpec
from gleanery.sources.base import Scan, newest, raw


def listed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of files; content is only read where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if recursive else path.rstrip("/") + "/*")


def directory(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    """Files of a directory, one level or recursively, whose whole name matches filenameFilter (unset: all).

    Ids are file:, the prefix and the path relative to the directory."""
    base = source.options["directory"].rstrip("/")
    files = listed(spark, base, source.flag("recursive", False)).where(named_like("path", source.options.get("filenameFilter")))
    # the part after the directory, whatever scheme Spark puts before it
    plain = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    after = quote("/" + plain.strip("/") + "/", safe="/%:")
    relative = F.coalesce(F.nullif(F.substring_index("path", after, -1), F.col("path")), F.substring_index("path", "/" + plain.strip("/") + "/", -1))
    ids = F.concat(F.lit("file:" + source.options.get("identifierPrefix", "")), relative)
    found = files.select(ids.alias("identifier"), F.col("modificationTime").alias("datestamp"), F.decode("content", "UTF-8").alias("xml"))
    return Scan(raw(found, source.id), watermark=newest(found))


def _entries(prefix: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, modified, content in zip(batch["path"], batch["modificationTime"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if not z.namelist():
                        raise ValueError(f"{path} is an empty archive")
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        changed = datetime(*info.date_time, tzinfo=timezone.utc)
                        yield pd.DataFrame({"identifier": [f"zip:{prefix}{info.filename}"], "name": [info.filename], "archive_time": [modified], "entry_time": [pd.Timestamp(changed)], "xml": [z.read(info).decode("utf-8", "replace")]})

    return run


def zip_entries(files: DataFrame, prefix: str = "") -> DataFrame:
    """(identifier, name, archive_time, entry_time, xml) of each file entry of archives (path, modificationTime, content)."""
    return files.select("path", "modificationTime", "content").mapInPandas(_entries(prefix), "identifier string, name string, archive_time timestamp, entry_time timestamp, xml string")


def archive(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    """Entries of ZIP archives whose last name segment matches filenameFilter.

    With useZipFileDate (default) the archive's date is the watermark and entries have none; an archive that is not newer
    gives nothing and lets nothing be deleted. Otherwise each entry has its own date."""
    files = spark.read.format("binaryFile").load(source.options["zipFile"])
    by_archive = source.flag("useZipFileDate", True)
    fresh = None
    if by_archive:
        fresh = files.agg(F.max("modificationTime")).first()[0]
        newer = files.agg(F.max("modificationTime").alias("t")).select(outdated(F.lit(watermark).cast("timestamp"), "t")).first()[0]
        if not newer:
            return Scan(raw(files.select(F.lit("").alias("identifier")).limit(0), source.id), complete=False)
    entries = zip_entries(files, source.options.get("identifierPrefix", "")).where(named_like("name", source.options.get("filenameFilter")))
    date = F.lit(None).cast("timestamp") if by_archive else F.col("entry_time")
    found = entries.select("identifier", date.alias("datestamp"), "xml")
    return Scan(raw(found, source.id), watermark=fresh if by_archive else newest(found))
