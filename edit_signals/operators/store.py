"""Keyed signal store: item layout and last-write-wins upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import signal_keys
from ..params import Arrival
from .arrival import arrival_key, packable_prefix

ITEM_COLUMNS = ["pk", "sk", "signalType", "windowStart", "windowEnd",
                "title", "editCount", "botEditCount", "totalEditCount", "ratio"]


def signal_items(signals: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Store items: keys, common fields (window bounds in epoch millis) and the variant's
    own fields; the other variant's fields are NULL (absent in the item)."""
    return signal_keys(signals).select(
        "pk", "sk",
        F.col("signal_type").alias("signalType"),
        F.unix_millis("window_start").alias("windowStart"),
        F.unix_millis("window_end").alias("windowEnd"),
        F.col("title"),
        F.col("edit_count").alias("editCount"),
        F.col("bot_edit_count").alias("botEditCount"),
        F.col("total_edit_count").alias("totalEditCount"),
        F.col("ratio"),
        *keep,
    )


def latest_items(items: DataFrame, key: str, order: str = "emitted", keep: Sequence[str] = ()) -> DataFrame:
    """The latest item per store key; "latest" is the greatest ``order`` (a struct of arrival columns, nulls
    first), then title. ``keep``: the order column, if it is wanted in the result.

    Hash aggregates only, reduced map-side. If the whole order packs into one key, items are first reduced per (pk,
    sk, title): all other values have a fixed size there, so ``max_by`` needs no sort. The titles of a window then
    compete by rank, each task passing on one row per key. A wider order is decided in two passes: the greatest packed
    prefix per key, joined back to the items, which leaves the few rows that share it to be ranked by the rest."""
    if key not in ("window", "window_title"):
        raise ValueError(f"unknown store key mode {key!r}")
    keys = ["pk", "sk"] + (["title"] if key == "window_title" else [])
    columns = [*ITEM_COLUMNS, *keep]
    kind = items.schema[order].dataType
    fields = kind.names if isinstance(kind, T.StructType) else [""]
    flat = items.withColumns({f"_o_{f}": F.col(f"{order}.{f}") if f else F.col(order) for f in fields})
    names = [f"_o_{f}" for f in fields]
    prefix = packable_prefix(flat, names)
    packed = arrival_key(flat, Arrival(order=tuple(prefix)), nulls_first=True) if prefix else F.lit(0)
    flat = flat.withColumn("_key", packed)
    rest = [F.col(c).desc() for c in names[len(prefix):]] + [F.col("title").desc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_key").desc(), *rest))
    if prefix == names and not keep:
        values = [c for c in ITEM_COLUMNS if c not in ("pk", "sk", "title", "signalType")]
        reduced = flat.groupBy("pk", "sk", "title").agg(*[F.max_by(c, "_key").alias(c) for c in values], F.max("_key").alias("_key"))
        if key == "window":
            reduced = reduced.withColumn("_rank", rank).filter("_rank = 1")
        return reduced.withColumn("signalType", F.col("pk")).select(*columns)
    top = flat.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.max("_key").alias("_top"))
    same = F.col("_key") == F.col("_top")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return flat.join(top, same).withColumn("_rank", rank).filter("_rank = 1").select(*columns)


def upsert_signals(signals: DataFrame, order: Sequence[str] = ("emitted",), key: str = "window") -> DataFrame:
    """Latest item per store key, where "latest" is the greatest ``order`` (arrival).

    ``key="window"`` (reference behaviour): key = (pk, sk), so two titles trending in the
    same window overwrite each other and only the later write survives.
    ``key="window_title"``: key = (pk, sk, title), nothing is lost.
    """
    items = signal_items(signals, keep=list(order))
    if len(order) > 1:
        items = items.withColumn("emitted", F.struct(*order))
    return latest_items(items, key, order[0] if len(order) == 1 else "emitted")
