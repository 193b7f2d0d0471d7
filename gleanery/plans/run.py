"""Runs: harvest sources into indexes, rebuild indexes from their own XML, update aliases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.evaluate import evaluated, index_columns, parse_policy, transformed, validated
from gleanery.operators.merge import seen_ids
from gleanery.operators.verdict import outdated
from gleanery.plans.config import Config, IndexSpec, PipelineSpec, SourceSpec
from gleanery.plans.index import Index
from gleanery.sources.base import Scan, open_source

LAST = "lastHarvested"


@dataclass
class Report:
    """What a run did, by source; errors by source that failed."""

    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def stored_time(text: str | None) -> datetime | None:
    """A stored instant; anything that is none counts as no date."""
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def time_text(t: datetime) -> str:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return t.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def prepared(scan: Scan, source: SourceSpec, pipeline: PipelineSpec, watermark: datetime | None) -> DataFrame:
    """The rows of a scan that need work: late ones go before any XML is parsed."""
    docs = scan.documents
    if scan.incremental:
        docs = docs.where(outdated(F.lit(watermark).cast("timestamp"), "datestamp"))
    docs = parse_policy(transformed(docs, source.transform, source.id, source.transform_params), source.options.get("parseErrorAction", "IGNOREDOCUMENT").upper())
    if source.flag("validate", True):
        docs = validated(docs, pipeline).drop("schema_errors")
    return docs


def harvest_source(spark: SparkSession, index: Index, source: SourceSpec, physical: str, opener: Callable[..., Scan] = open_source) -> dict[str, int]:
    """One source into one index: rows first, the watermark after them, so a failed run is simply repeated."""
    old = stored_time(index.metadata(source.id).get(LAST))
    scan = opener(spark, source, old)
    docs = prepared(scan, source, index.pipeline, old)
    changes = evaluated(docs, index.pipeline, source.id, source.options.get("conversionErrorAction", "STOP").upper())
    changes = changes.persist()
    try:
        seen = None
        if scan.complete and source.flag("deleteMissingDocuments", True):
            seen = seen_ids(scan.documents, deleted="deleted" if scan.only_live else None)
        index.apply(changes.select("op", "seq", *index_columns(index.pipeline)), physical, seen, source.id)
        counts = {r["op"]: r["n"] for r in changes.groupBy("op").agg(F.count("*").alias("n")).collect()}
    finally:
        changes.unpersist()
    fresh = scan.watermark() if callable(scan.watermark) else scan.watermark
    if fresh is not None:
        if fresh.tzinfo is None:
            fresh = fresh.replace(tzinfo=timezone.utc)
        index.save_metadata(source.id, {LAST: time_text(max(fresh, old) if old else fresh)})
    return counts


def harvest(spark: SparkSession, config: Config, root: str, which: str | None = None, opener: Callable[..., Scan] = open_source) -> Report:
    """Harvest what an id (or *) stands for. A failing source doesn't stop the others."""
    report = Report()
    for spec, sources in config.chosen(which):
        index = Index(spark, root, spec, config.pipeline)
        physical = index.create()
        for source in sources:
            try:
                report.counts[source.id] = harvest_source(spark, index, source, physical, opener)
            except Exception as e:  # noqa: BLE001  reported, not hidden
                report.errors[source.id] = str(e)
    return report


def rebuild(spark: SparkSession, config: Config, root: str, which: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, finish: Callable[[Index], None] | None = None) -> Report:
    """Run the pipeline again over the stored XML into the other physical index, then swap. Watermarks stay.

    The XML is final: no transform and no validation. Rows without XML go. prepare and finish are hooks."""
    report = Report()
    for spec, _ in config.chosen(which):
        index = Index(spark, root, spec, config.pipeline)
        old = index.read()
        physical = index.create(rebuild=True)
        try:
            changes = None  # all sources are written at once
            for source in spec.sources:
                own = stored_documents(old, config.pipeline, source.id)
                own = prepare(own) if prepare else own
                one = evaluated(own, config.pipeline, source.id, source.options.get("conversionErrorAction", "STOP").upper()).select("op", "seq", *index_columns(config.pipeline))
                changes = one if changes is None else changes.union(one)
            if changes is not None:
                index.apply(changes, physical)
            kept = index.read(physical).groupBy(F.col(config.pipeline.source_field).alias("source")).count().collect()  # a row for each source
            report.counts |= {source.id: {"index": next((r["count"] for r in kept if r["source"] == source.id), 0)} for source in spec.sources}
            if finish:
                finish(index)
            index.swap(physical)
        except Exception as e:  # noqa: BLE001  the old index stays current
            report.errors[spec.name] = str(e)
    return report


def stored_documents(table: DataFrame, pipeline: PipelineSpec, source: str | None = None) -> DataFrame:
    """Raw documents of an index table: only the id, date and XML columns are read."""
    rows = table.where(F.col(pipeline.source_field) == source) if source is not None else table
    return rows.select(F.col("id").alias("identifier"), F.col(pipeline.datestamp_field).alias("datestamp"), F.col(pipeline.xml_field).isNull().alias("deleted"), F.col(pipeline.xml_field).alias("xml"), F.col(pipeline.source_field).alias("source"), F.lit(0).cast("long").alias("seq"))


def update_aliases(spark: SparkSession, config: Config, root: str, which: str | None = None) -> None:
    for spec, _ in config.chosen(which):
        Index(spark, root, spec, config.pipeline).update_aliases()


def open_index(spark: SparkSession, config: Config, root: str, name: str) -> Index:
    spec: IndexSpec = next(i for i in config.indexes if i.name == name)
    return Index(spark, root, spec, config.pipeline)
