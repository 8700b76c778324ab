"""Recent-signals report: newest N by arrival, and its JSON array form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import signal_wire_struct
from ..params import RECENT_SIGNALS


def newest_first(signals: DataFrame) -> list[Column]:
    """Total order, newest first: arrival (``emitted``) when present, else window end;
    then signal type and title to break ties."""
    lead = [F.col("emitted").desc()] if "emitted" in signals.columns else []
    return lead + [F.col("window_end").desc(), F.col("signal_type").asc(), F.col("title").asc_nulls_first()]


def recent_signals(signals: DataFrame, n: int = RECENT_SIGNALS, order: Sequence[Column] | None = None) -> DataFrame:
    """The newest ``n`` signals (repeats kept). Planned as TakeOrderedAndProject: each
    partition keeps its own top ``n``, only those reach the final merge."""
    order = list(order) if order is not None else newest_first(signals)
    return signals.orderBy(*order).limit(n)


def signals_json(signals: DataFrame, n: int = RECENT_SIGNALS, order: Sequence[Column] | None = None) -> DataFrame:
    """One row, ``signals_json``: the tagged JSON array of the newest ``n`` signals in report order
    (``[]`` when empty)."""
    order = list(order) if order is not None else newest_first(signals)
    from pyspark.sql import Window
    ranked = recent_signals(signals, n, order).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    entries = F.array_sort(F.collect_list(F.struct(F.col("_rank"), signal_wire_struct().alias("s"))))
    return ranked.agg(F.to_json(F.transform(entries, lambda e: e["s"])).alias("signals_json"))
