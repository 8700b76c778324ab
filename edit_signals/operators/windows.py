"""Tumbling-window aggregates (epoch-aligned ``[start, end)`` windows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import window_duration
from .filters import drop_null_keys


def tumbling(df: DataFrame, width: int | str, time_col: str = "event_time") -> DataFrame:
    """Adds ``window_start`` / ``window_end`` of the tumbling window holding ``time_col``."""
    w = F.window(F.col(time_col), window_duration(width))
    return df.withColumn("_w", w).withColumns({"window_start": F.col("_w.start"),
                                               "window_end": F.col("_w.end")}).drop("_w")


def bot_ratio(bot: Column, total: Column) -> Column:
    """bot / total as a double; 0.0 for an empty window."""
    return F.when(total == 0, F.lit(0.0)).otherwise(bot.cast("double") / total.cast("double"))


def is_bot() -> Column:
    return F.coalesce(F.col("bot"), F.lit(False))


def tumbling_edit_counts(edits: DataFrame, width: int | str, keys: Sequence[str] = ("title",),
                         time_col: str = "event_time", extra: dict[str, Column] | None = None) -> DataFrame:
    """Edits per (key, window). Rows with a NULL key are dropped first.
    Plan: partial hash aggregate -> exchange on (key, window) -> final aggregate."""
    w = F.window(F.col(time_col), window_duration(width))
    return (
        drop_null_keys(edits, keys)
        .groupBy(*[F.col(k) for k in keys], w.alias("_w"))
        .agg(F.count(F.lit(1)).alias("edit_count"), *_aggs(extra))
        .select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                "edit_count", *(extra or {}))
    )


def tumbling_bot_counts(edits: DataFrame, width: int | str, time_col: str = "event_time",
                        extra: dict[str, Column] | None = None) -> DataFrame:
    """Per window: total edits, bot edits and their ratio over ALL edits (NULL titles too).

    There is no constant grouping key: the aggregate groups by window only and the
    partial aggregate collapses each input partition to one row per window before the
    exchange, so a busy window never lands whole on one task.
    """
    w = F.window(F.col(time_col), window_duration(width))
    return (
        edits.groupBy(w.alias("_w"))
        .agg(F.count(F.lit(1)).alias("total_edit_count"),
             F.count_if(is_bot()).alias("bot_edit_count"), *_aggs(extra))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                "total_edit_count", "bot_edit_count",
                bot_ratio(F.col("bot_edit_count"), F.col("total_edit_count")).alias("ratio"),
                *(extra or {}))
    )


def _aggs(extra: dict[str, Column] | None) -> list[Column]:
    """Extra aggregates carried along (e.g. the last arrival of a window)."""
    return [c.alias(n) for n, c in (extra or {}).items()]
