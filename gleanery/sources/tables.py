"""Documents out of tables: index tables, and exports of older stores with deflated XML."""

from __future__ import annotations

import zlib
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.scalars import epoch_millis, stored_instant
from gleanery.operators.search import query
from gleanery.plans.config import SourceSpec
from gleanery.sources.base import Scan, newest, raw


def table_documents(table: DataFrame, source: str, prefix: str = "", xml_field: str = "xml", datestamp_field: str = "internal-datestamp", json_query: str | None = None, query_string: str | None = None) -> DataFrame:
    """Documents of an index table; rows without XML are left out, so they don't count as seen. Only the id, date and XML
    columns (and those of the query) are read."""
    rows = query(table, json_query, query_string)
    date = F.col(f"`{datestamp_field}`")
    if isinstance(table.schema[datestamp_field].dataType, T.StringType):
        date = stored_instant(date)
    rows = rows.where(F.col(f"`{xml_field}`").isNotNull())
    return raw(rows.select(F.concat(F.lit(prefix), "id").alias("identifier"), date.alias("datestamp"), F.col(f"`{xml_field}`").alias("xml")), source)


def table_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    """Index tables below tableRoot, by names in `indexes`."""
    o = source.options
    names = [n for n in o["indexes"].replace(",", " ").split() if n]
    found = None
    for name in names:
        table = spark.read.parquet(f"{o.get('tableRoot', '.').rstrip('/')}/{name}")
        one = table_documents(table, source.id, o.get("identifierPrefix", ""), o.get("xmlField", "xml"), o.get("datestampField", "internal-datestamp"), o.get("jsonQuery"), o.get("queryString"))
        found = one if found is None else found.unionByName(one)
    return Scan(found, watermark=newest(found))


def inflated(column) -> Column:
    """UTF-8 text of zlib streams; plain bytes stay."""

    @F.pandas_udf(T.StringType())
    def run(content: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return zlib.decompress(b).decode()
            except zlib.error:
                return bytes(b).decode("utf-8", "replace")

        return content.map(one)

    return run(column)


def legacy_documents(table: DataFrame, source: str, prefix: str = "", query_string: str | None = None) -> DataFrame:
    """Documents of an exported table: internal-identifier, internal-datestamp (milliseconds; negative: none) and
    internal-xml (text, or bytes that may be deflated)."""
    rows = query(table, None, query_string)
    xml = F.col("`internal-xml`")
    if isinstance(table.schema["internal-xml"].dataType, T.BinaryType):
        xml = inflated(xml)
    rows = rows.where(F.col("`internal-identifier`").isNotNull() & F.col("`internal-xml`").isNotNull())
    return raw(rows.select(F.concat(F.lit(prefix), "`internal-identifier`").alias("identifier"), epoch_millis(F.col("`internal-datestamp`")).alias("datestamp"), xml.alias("xml")), source)


def legacy_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    o = source.options
    found = legacy_documents(spark.read.parquet(o["indexDir"]), source.id, o.get("identifierPrefix", ""), o.get("query"))
    return Scan(found, watermark=newest(found))
