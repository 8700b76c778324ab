"""Zero-grace late-record drop, exact in batch.

A record is late iff the end of its window is <= the highest event time seen so far in
arrival order (within its stream-time scope, ``Arrival.partitions``).

Equivalently: a record r is late iff some record s in a *later* window of the same scope
arrived before r. So it is enough to know, per window, the first arrival of any record in a later one.

Time is cut into panes, whose width divides the widths of all windows in question (their greatest common
divisor). One partial aggregate gives the first arrival per pane; a suffix minimum over the panes gives
the closing arrival of every window of every width; one join brings them back to the rows. So the
lateness of both detectors costs one extra scan of two or three columns, no ordering of the rows, no job at
plan-build time, and a table of the size of the panes. AQE chooses the join and splits a busy pane if it shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Arrival, window_micros
from .arrival import arrival_key, arrival_struct, split_key


def _arrival_key(df: DataFrame, arrival: Arrival):
    """Packed scalar (hash aggregate) when possible, else the struct (sort aggregate)."""
    key = arrival_key(df, arrival)
    return arrival_struct(arrival) if key is None else key


# Panes per block of the suffix minimum.
FANOUT = 1024


def pane_micros(*widths: int | str) -> int:
    """Width of the panes that windows of all these widths are made of."""
    return math.gcd(*[window_micros(w) for w in widths])


def pane_start(width_us: int, time_col: str = "event_time") -> Column:
    """Start (epoch microseconds) of the pane or window of ``width_us`` that holds a time; null for none."""
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    return us - F.pmod(us, F.lit(width_us))


def first_arrivals(edits: DataFrame, width: int | str, arrival: Arrival, time_col: str = "event_time") -> DataFrame:
    """Per (scope, window): ``_first`` = earliest arrival of its records; ``_ws`` and ``_we`` are its bounds."""
    us = window_micros(width)
    return pane_firsts(edits, us, arrival, time_col).select(
        *arrival.partitions, F.timestamp_micros("_pane").alias("_ws"),
        F.timestamp_micros(F.col("_pane") + F.lit(us)).alias("_we"), "_first")


def pane_firsts(edits: DataFrame, pane_us: int, arrival: Arrival, time_col: str = "event_time") -> DataFrame:
    """Per (scope, pane): ``_first`` = earliest arrival of its records.

    A hash aggregate with a partial step. An order too wide to pack is reduced in two steps:
    per (scope, pane, ``arrival.split``) on the columns that do pack, then over that small table.
    """
    pane = pane_start(pane_us, time_col).alias("_pane")
    edits = edits.filter(F.col(time_col).isNotNull())
    packed, rest = split_key(edits, arrival)
    if packed is None or not rest:
        return edits.groupBy(*arrival.partitions, pane).agg(F.min(_arrival_key(edits, arrival)).alias("_first"))
    firsts = edits.groupBy(*arrival.partitions, pane, *arrival.split).agg(
        *[F.min_by(F.col(c), packed).alias(c) for c in rest])
    return firsts.groupBy(*arrival.partitions, "_pane").agg(F.min(arrival_struct(arrival)).alias("_first"))


def closing_arrivals(firsts: DataFrame, pane_us: int, widths: dict[str, int], scope: tuple[str, ...] = (),
                     fanout: int = FANOUT) -> DataFrame:
    """Per (scope, pane): for every width (microseconds) the earliest arrival among later windows, null
    if there is none.

    A row per block of ``fanout`` panes holds them sorted; their suffix minimum is folded over that
    array, and a window over the blocks of a scope adds what comes after the block."""
    block = F.col("_pane") - F.pmod("_pane", F.lit(pane_us * fanout))
    after = Window.partitionBy(*scope).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (firsts.groupBy(*scope, block.alias("_block"))
              .agg(F.sort_array(F.collect_list(F.struct("_pane", "_first")), asc=False).alias("_panes"))
              .withColumn("_after", F.min(F.array_min(F.col("_panes._first"))).over(after)))
    kind = firsts.schema["_first"].dataType.simpleString()
    later = F.aggregate(
        "_panes", F.struct(F.col("_after").alias("least"), F.array().cast(f"array<struct<_pane:bigint,_later:{kind}>>").alias("done")),
        lambda acc, x: F.struct(
            F.least(acc["least"], x["_first"]).alias("least"),
            F.concat(acc["done"], F.array(F.struct(x["_pane"].alias("_pane"), acc["least"].alias("_later")))).alias("done")),
        lambda acc: acc["done"])
    panes = blocks.select(*scope, F.explode(later).alias("_p")).select(*scope, "_p._pane", "_p._later")
    for name, us in widths.items():
        if us == pane_us:
            closed = F.col("_later")
        else:  # nothing of the window comes after its last pane
            closed = F.max_by("_later", "_pane").over(Window.partitionBy(*scope, F.col("_pane") - F.pmod("_pane", F.lit(us))))
        panes = panes.withColumn(name, closed)
    return panes.drop("_later")


def flag_late_by(edits: DataFrame, widths: dict[str, int | str], arrival: Arrival = Arrival(), time_col: str = "event_time",
                 fanout: int = FANOUT) -> DataFrame:
    """Adds a boolean column per entry of ``widths`` (column: window width). Lazy: nothing is cached and no job runs
    here; AQE picks the join back from the size the pane table turns out to have."""
    if arrival.order[0] == time_col:
        raise ValueError(f"arrival order {arrival.order} starts with the event time: nothing could be late")
    pane_us = pane_micros(*widths.values())
    by_width = {f"_closed_{name}": window_micros(w) for name, w in widths.items()}
    closing = closing_arrivals(pane_firsts(edits, pane_us, arrival, time_col), pane_us, by_width, arrival.partitions, fanout)
    tagged = edits.withColumn("_pane", pane_start(pane_us, time_col)).join(closing, [*arrival.partitions, "_pane"], "left")
    late = {name: F.coalesce(F.col(f"_closed_{name}") <= _arrival_key(edits, arrival), F.lit(False)) for name in widths}
    return tagged.withColumns(late).drop("_pane", *by_width)


def flag_late(edits: DataFrame, width: int | str, arrival: Arrival = Arrival(), time_col: str = "event_time",
              fanout: int = FANOUT) -> DataFrame:
    """Adds boolean ``late`` for windows of one width."""
    return flag_late_by(edits, {"late": width}, arrival, time_col, fanout)


def apply_late(edits: DataFrame, width: int | str, arrival: Arrival | None, late: str = "keep") -> DataFrame:
    """``late="keep"``: all records; ``late="drop"``: only those a zero-grace window accepts."""
    if late == "keep":
        return edits
    if late != "drop":
        raise ValueError(f"late must be 'keep' or 'drop', got {late!r}")
    if arrival is None:
        raise ValueError("late='drop' needs the arrival order (arrival=Arrival(...))")
    return drop_late(edits, width, arrival)


def drop_late(edits: DataFrame, width: int | str, arrival: Arrival = Arrival(), time_col: str = "event_time") -> DataFrame:
    """Records that a zero-grace tumbling window of ``width`` would still accept."""
    return flag_late(edits, width, arrival, time_col).filter(~F.col("late")).drop("late")


def late_rows(edits: DataFrame, width: int | str, arrival: Arrival = Arrival(), time_col: str = "event_time") -> DataFrame:
    """The records a zero-grace window of ``width`` drops."""
    return flag_late(edits, width, arrival, time_col).filter(F.col("late")).drop("late")
