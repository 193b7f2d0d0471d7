"""Predicates on documents, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import last_segment, no_fragment

STOP, IGNORE, DELETE = "STOP", "IGNOREDOCUMENT", "DELETEDOCUMENT"


def accepted(chain: Sequence[tuple[bool, Column]], default: bool = True) -> Column:
    """Accept and deny filters in their order; the last one that matches decides."""
    out = F.lit(default)
    for accept, condition in chain:
        out = F.when(condition, F.lit(accept)).otherwise(out)
    return out


def operation(accept: Column) -> Column:
    """A rejected document is deleted, not skipped."""
    return F.when(accept, F.lit("index")).otherwise(F.lit("delete"))


def outdated(watermark, changed) -> Column:
    """Whether a document is to be processed: no watermark, no date, or a later date."""
    watermark = watermark if isinstance(watermark, Column) else F.lit(watermark)
    changed = F.col(changed) if isinstance(changed, str) else changed
    return watermark.isNull() | changed.isNull() | (changed > watermark)


def in_sets(sets, wanted: Sequence[str]) -> Column:
    """Whether a record is in one of the wanted sets; all are if none is named."""
    sets = F.col(sets) if isinstance(sets, str) else sets
    return F.coalesce(F.arrays_overlap(sets, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def named_like(path, pattern: str | None) -> Column:
    """Whether the last path segment matches the whole pattern; no pattern fits all."""
    return last_segment(path).rlike(f"^(?:{pattern})$") if pattern else F.lit(True)


def crawlable(url, base: str, exclude: str | None = None) -> Column:
    """Whether a URL lies under the base and no part of it matches the exclusion."""
    url = no_fragment(url)
    inside = url.startswith(base)
    return inside & ~url.rlike(exclude) if exclude else inside


def with_policy(changes: DataFrame, policy: str = STOP, error: str = "error", op: str = "op") -> DataFrame:
    """Apply a policy to rows with an error: stop the run, leave the row out, or turn it into a delete."""
    if policy == IGNORE:
        return changes.where(F.col(error).isNull())
    if policy == DELETE:
        return changes.withColumn(op, F.when(F.col(error).isNotNull(), F.lit("delete")).otherwise(F.col(op)))
    if policy != STOP:
        raise ValueError(f"unknown policy: {policy}")
    return changes.withColumn(op, F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("document "), F.col("identifier"), F.lit(": "), F.col(error))).cast("string")).otherwise(F.col(op)))
