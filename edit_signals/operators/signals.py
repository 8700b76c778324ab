"""Detection: threshold predicates, signal mapping, final per-window signals, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BOT_ANOMALY, GLOBAL_KEY, TRENDING, Arrival, BotParams, TrendingParams, window_duration
from .arrival import arrival_key, arrival_struct, split_key
from .lateness import apply_late, flag_late_by
from .windows import bot_ratio, is_bot, tumbling_bot_counts, tumbling_edit_counts


def _null_count():
    return F.lit(None).cast("bigint")


def trends(edits: Column, threshold: int) -> Column:
    """Inclusive: a window with exactly ``threshold`` edits trends."""
    return edits >= F.lit(threshold)


def bots_dominate(total: Column, ratio: Column, ratio_threshold: float, min_volume: int) -> Column:
    """Volume inclusive, ratio strict: 8/10 does not exceed 0.8."""
    return (total >= F.lit(min_volume)) & (ratio > F.lit(float(ratio_threshold)))


def trending_filter(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.filter(trends(F.col("edit_count"), threshold))


def bot_anomaly_filter(counts: DataFrame, ratio_threshold: float, min_volume: int) -> DataFrame:
    return counts.filter(bots_dominate(F.col("total_edit_count"), F.col("ratio"), ratio_threshold, min_volume))


def to_trending_signal(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return counts.select(
        F.lit(TRENDING).alias("signal_type"),
        F.col("title"),
        F.col("edit_count").cast("bigint").alias("edit_count"),
        _null_count().alias("bot_edit_count"),
        _null_count().alias("total_edit_count"),
        F.lit(None).cast("double").alias("ratio"),
        "window_start", "window_end",
        F.col("title").alias("key"),
        *keep,
    )


def to_bot_signal(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return counts.select(
        F.lit(BOT_ANOMALY).alias("signal_type"),
        F.lit(None).cast("string").alias("title"),
        _null_count().alias("edit_count"),
        F.col("bot_edit_count").cast("bigint").alias("bot_edit_count"),
        F.col("total_edit_count").cast("bigint").alias("total_edit_count"),
        F.col("ratio").cast("double").alias("ratio"),
        "window_start", "window_end",
        F.lit(GLOBAL_KEY).alias("key"),
        *keep,
    )


def _last_arrival(edits: DataFrame, arrival: Arrival | None) -> dict[str, Column] | None:
    """The struct ``emitted`` of the record that produced the final state = when the final
    signal is emitted. Each component is taken with ``max_by`` on the packed key so the
    aggregate stays hash-based."""
    if arrival is None:
        return None
    key = arrival_key(edits, arrival)
    if key is None:
        return {"emitted": F.max_by(_emitted_struct(arrival), arrival_struct(arrival))}
    return {f"_em_{c}": F.max_by(F.col(c), key) for c in arrival.emitted_columns}


def _emitted_struct(arrival: Arrival) -> Column:
    return F.struct(*[F.col(c) for c in arrival.emitted_columns])


def _with_emitted(counts: DataFrame, arrival: Arrival | None) -> DataFrame:
    if arrival is None or "emitted" in counts.columns:
        return counts
    parts = {c: f"_em_{c}" for c in arrival.emitted_columns}
    return counts.withColumn("emitted", F.struct(*[F.col(p).alias(c) for c, p in parts.items()])).drop(*parts.values())


def _bot_counts(edits: DataFrame, width: int | str, arrival: Arrival | None) -> DataFrame:
    """Bot counts with ``emitted``. An order too wide to pack is reduced per (window, split columns)
    first, so the data-sized aggregate stays hash-based and only that small table is sorted."""
    packed, _ = (None, []) if arrival is None else split_key(edits, arrival)
    if packed is None:
        return _with_emitted(tumbling_bot_counts(edits, width, extra=_last_arrival(edits, arrival)), arrival)
    cols = [c for c in dict.fromkeys((*arrival.order, *arrival.emitted_columns)) if c not in arrival.split]
    per = (edits.groupBy(F.window("event_time", window_duration(width)).alias("_w"), *arrival.split)
           .agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_bot()).alias("_nb"),
                *[F.max_by(F.col(c), packed).alias(c) for c in cols]))
    total, bots = F.col("total_edit_count"), F.col("bot_edit_count")
    return (per.groupBy("_w").agg(F.sum("_n").alias("total_edit_count"), F.sum("_nb").alias("bot_edit_count"),
                                  F.max_by(_emitted_struct(arrival), arrival_struct(arrival)).alias("emitted"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "total_edit_count", "bot_edit_count", bot_ratio(bots, total).alias("ratio"), "emitted"))


def trending_signals(edits: DataFrame, params: TrendingParams = TrendingParams(), keys: Sequence[str] = ("title",),
                     arrival: Arrival | None = None, late: str = "keep") -> DataFrame:
    """Final trending signal per (title, window): edit count >= threshold.

    ``late="drop"`` first removes the records a zero-grace window would reject
    (needs ``arrival``); ``arrival`` also adds ``emitted`` (last contributing arrival).
    """
    src = apply_late(edits, params.window, arrival, late)
    extra = _last_arrival(src, arrival)
    counts = _with_emitted(tumbling_edit_counts(src, params.window, keys, extra=extra), arrival)
    keep = [k for k in keys if k != "title"] + (["emitted"] if arrival is not None else [])
    return to_trending_signal(trending_filter(counts, params.threshold), keep)


def bot_anomaly_signals(edits: DataFrame, params: BotParams = BotParams(), arrival: Arrival | None = None,
                        late: str = "keep") -> DataFrame:
    """Final bot-anomaly signal per window: total >= min volume and bot ratio > threshold."""
    src = apply_late(edits, params.window, arrival, late)
    counts = _bot_counts(src, params.window, arrival)
    keep = ["emitted"] if arrival is not None else []
    return to_bot_signal(bot_anomaly_filter(counts, params.ratio_threshold, params.min_volume), keep)


def detect_signals(edits: DataFrame, trending: TrendingParams = TrendingParams(), bot: BotParams = BotParams(),
                   arrival: Arrival | None = None, late: str = "keep",
                   bot_arrival: Arrival | None = None) -> DataFrame:
    """Both detectors over the same edits, concatenated (UNION ALL, duplicates kept).

    ``bot_arrival`` (default ``arrival``) is the order seen by the bot branch: keyed
    topics keep one clock per input partition for trending, while the bot branch's
    re-key funnels everything through one clock (see ``sources.records``).

    With one arrival order both detectors share one scan and one aggregate (see
    :func:`shared_detect`); with different orders per branch they are planned separately."""
    if bot_arrival is None or bot_arrival == arrival:
        return shared_detect(edits, trending, bot, arrival, late)
    if arrival is not None and arrival.emitted_columns != bot_arrival.emitted_columns:
        raise ValueError("both branches need the same emitted columns, or their signals cannot be ordered")
    t = trending_signals(edits, trending, arrival=arrival, late=late)
    b = bot_anomaly_signals(edits, bot, arrival=bot_arrival, late=late)
    return t.unionByName(b, allowMissingColumns=True)


def shared_detect(edits: DataFrame, trending: TrendingParams = TrendingParams(), bot: BotParams = BotParams(),
                  arrival: Arrival | None = None, late: str = "keep") -> DataFrame:
    """Both detectors from one scan: every edit is tagged into its trending window (keyed
    by title) and its bot window (no key), one hash aggregate counts both, and one
    projection emits the wide signal row of either kind. Halves the scan I/O of running
    the two branches separately; a busy window is still pre-aggregated map-side.
    ``late="drop"``: the lateness of both widths comes from one pane table (one more scan, of the
    times only) joined on the same scan, and a row is dropped only from the branch that rejects it."""
    if late == "drop":
        if arrival is None:
            raise ValueError("late='drop' needs the arrival order (arrival=Arrival(...))")
        edits = flag_late_by(edits, {"_late_t": trending.window, "_late_b": bot.window}, arrival)
    elif late == "keep":
        edits = edits.withColumns({"_late_t": F.lit(False), "_late_b": F.lit(False)})
    else:
        raise ValueError(f"late must be 'keep' or 'drop', got {late!r}")
    cols = ["title", "bot", *(dict.fromkeys((*arrival.order, *arrival.emitted_columns)) if arrival else ())]
    tagged = (edits
              .withColumn("_wt", F.window("event_time", window_duration(trending.window)))
              .withColumn("_wb", F.window("event_time", window_duration(bot.window)))
              .select(F.explode(F.array(
                  F.struct(F.lit(TRENDING).alias("signal_type"), F.col("_wt").alias("_w"),
                           F.col("_late_t").alias("_late"), *[F.col(c) for c in cols]),
                  F.struct(F.lit(BOT_ANOMALY).alias("signal_type"), F.col("_wb").alias("_w"),
                           F.col("_late_b").alias("_late"), F.lit(None).cast("string").alias("title"),
                           *[F.col(c) for c in cols[1:]]),
              )).alias("_r"))
              .select("_r.*"))
    is_tr = F.col("signal_type") == TRENDING
    # NULL titles never trend; late rows leave only the branch that rejects them
    tagged = tagged.filter(~F.col("_late") & (~is_tr | F.col("title").isNotNull()))
    extra = _last_arrival(tagged, arrival) or {}
    counts = (tagged.groupBy("signal_type", "_w", "title")
              .agg(F.count(F.lit(1)).alias("_n"),
                   F.count_if(F.coalesce(F.col("bot"), F.lit(False))).alias("_nb"),
                   *[c.alias(n) for n, c in extra.items()]))
    counts = _with_emitted(counts, arrival)
    ratio = bot_ratio(F.col("_nb"), F.col("_n"))
    keep = (is_tr & trends(F.col("_n"), trending.threshold)) | (
        ~is_tr & bots_dominate(F.col("_n"), ratio, bot.ratio_threshold, bot.min_volume))
    return counts.filter(keep).select(
        "signal_type",
        F.col("title"),
        F.when(is_tr, F.col("_n")).alias("edit_count"),
        F.when(~is_tr, F.col("_nb")).alias("bot_edit_count"),
        F.when(~is_tr, F.col("_n")).alias("total_edit_count"),
        F.when(~is_tr, ratio).alias("ratio"),
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        F.when(is_tr, F.col("title")).otherwise(F.lit(GLOBAL_KEY)).alias("key"),
        *(["emitted"] if arrival is not None else []),
    )


# The batch final state of each window is the reference's last emitted revision.
final_signals = detect_signals
