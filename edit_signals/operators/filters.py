"""Row-level operators of the ingest chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def main_namespace(edits: DataFrame) -> DataFrame:
    """Keep main-namespace edits (absent namespace counts as 0)."""
    return edits.filter(F.coalesce(F.col("namespace"), F.lit(0)) == 0)


def key_by_title(edits: DataFrame, keys: Sequence[str] = ("title",)) -> DataFrame:
    """Record key: the title only by default, so equal titles on different wikis count together.
    ``keys=("wiki", "title")`` keys per wiki instead."""
    if list(keys) == ["title"]:
        key = F.col("title")
    else:
        key = F.when(F.greatest(*[F.col(k).isNull() for k in keys]), F.lit(None)) \
               .otherwise(F.concat_ws(":", *[F.col(k) for k in keys]))
    return edits.withColumn("key", key)


def drop_null_keys(edits: DataFrame, keys: Sequence[str] = ("title",)) -> DataFrame:
    """Rows with a NULL key never reach a keyed aggregation."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return edits.filter(cond)


def with_event_time(edits: DataFrame, source: str = "record", record_col: str = "record_ts") -> DataFrame:
    """``event_time`` from the record timestamp (the reference's behaviour) or from the
    payload's epoch-second ``timestamp``."""
    if source == "record":
        return edits.withColumn("event_time", F.col(record_col).cast("timestamp"))
    if source == "payload":
        return edits.withColumn("event_time", F.timestamp_seconds(F.col("timestamp")))
    raise ValueError(f"unknown time source {source!r}")
