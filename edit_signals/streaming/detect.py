"""Streaming detection: event records -> merged signals.

Both detectors share one scan and one stateful aggregate: every edit is tagged into its trending window
(keyed by title) and its bot window (no key), and rows are grouped by (detector, window, key). The watermark has zero
delay: a record whose window already ended at or before the watermark is dropped, as in the reference's
no-grace windows; lateness is judged per micro-batch (exact per-record lateness is ``streaming.exact``, and the batch
``drop_late``).

``output_mode="append"``: one final row per window once the watermark passes its end; the windows still
open can be read from the state (:func:`open_windows`).
``output_mode="update"``: every micro-batch emits the windows it changed that pass the
predicate - revisions, as the reference emits on every update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encode_signals
from ..operators.lateness import pane_start
from ..operators.signals import bots_dominate, trends
from ..operators.windows import bot_ratio, is_bot
from ..params import BOT_ANOMALY, GLOBAL_KEY, TRENDING, BotParams, TrendingParams, window_micros
from ..sinks import stream_records
from ..sources.records import kafka_available, read_event_records, read_landed_edits, records_to_edits
from .common import DETECTION_CONFS, await_done, session_confs, start, state_confs, write_batch_partition

# Grouping columns of the aggregate: detector, window bounds, key (null for bots).
WINDOW_KEYS = ("signal_type", "window_start", "window_end", "title")
# Mark of a time column that state is kept and dropped by (Spark sets it on the column of ``withWatermark``).
_WATERMARK = {"spark.watermarkDelayMs": 0}


def window_totals(edits: DataFrame, trending: TrendingParams | None, bot: BotParams | None,
                  watermark: str = "0 seconds") -> DataFrame:
    """Per (detector, window, key): edits ``n``, bot edits ``nb``, latest record time and offset. One scan, one aggregate.

    The window bounds are plain columns, since one ``window()`` has one width. The end carries the watermark of the time
    it is computed from: a window closes, and its late rows are dropped, when the watermark reaches its end."""
    ev = edits.withWatermark("event_time", watermark)
    offset = F.col("offset") if "offset" in edits.columns else F.lit(None).cast("bigint")

    def tagged(kind, params, title):  # noqa: ANN001, ANN202 - a row of one detector's branch
        us = window_micros(params.window)
        start = pane_start(us)
        return F.struct(F.lit(kind).alias("signal_type"), F.timestamp_micros(start).alias("window_start"),
                        F.timestamp_micros(start + F.lit(us)).alias("window_end"), title.alias("title"),
                        is_bot().alias("bot"), F.col("event_time").alias("ts"), offset.alias("offset"))

    branches = []
    if trending is not None:
        branches.append(tagged(TRENDING, trending, F.col("title")))
    if bot is not None:
        branches.append(tagged(BOT_ANOMALY, bot, F.lit(None).cast("string")))
    rows = ev.select(F.explode(F.array(*branches)).alias("_r")).select("_r.*")
    rows = rows.filter(F.col("window_start").isNotNull() & ((F.col("signal_type") != TRENDING) | F.col("title").isNotNull()))
    end = F.col("window_end").alias("window_end", metadata=_WATERMARK)
    return rows.select("signal_type", "window_start", end, "title", "bot", "ts", "offset").groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bot").alias("nb"), F.max("ts").alias("_signal_ts"),
        F.max("offset").alias("_signal_offset"))


def totals_to_signals(totals: DataFrame, trending: TrendingParams | None, bot: BotParams | None) -> DataFrame:
    """Signals of the windows that pass their detector, with the time and offset of the last edit that went in."""
    is_tr, ratio = F.col("signal_type") == TRENDING, bot_ratio(F.col("nb"), F.col("n"))
    keep = F.lit(False)
    if trending is not None:
        keep = keep | (is_tr & trends(F.col("n"), trending.threshold))
    if bot is not None:
        keep = keep | (~is_tr & bots_dominate(F.col("n"), ratio, bot.ratio_threshold, bot.min_volume))
    return totals.filter(keep).select(
        "signal_type", "title", F.when(is_tr, F.col("n")).alias("edit_count"), F.when(~is_tr, F.col("nb")).alias("bot_edit_count"),
        F.when(~is_tr, F.col("n")).alias("total_edit_count"), F.when(~is_tr, ratio).alias("ratio"),
        "window_start", "window_end", F.when(is_tr, F.col("title")).otherwise(F.lit(GLOBAL_KEY)).alias("key"),
        "_signal_ts", "_signal_offset")


def detection_stream(edits: DataFrame, trending: TrendingParams | None = TrendingParams(),
                     bot: BotParams | None = BotParams(), watermark: str = "0 seconds") -> DataFrame:
    """Signals of a streaming (or batch) edits DataFrame with ``event_time``."""
    if trending is None and bot is None:
        raise ValueError("a detector is needed")
    return totals_to_signals(window_totals(edits, trending, bot, watermark), trending, bot)


def open_windows(spark: SparkSession, checkpoint: str, trending: TrendingParams | None = TrendingParams(),
                 bot: BotParams | None = BotParams()) -> DataFrame:
    """Signals of the windows a detection query still holds in its state, read from its checkpoint with Spark's state
    data source. With append mode these are the signals it has not emitted yet."""
    state = spark.read.format("statestore").load(checkpoint)
    # the value holds the aggregation buffers in the order of the aggregates, under names that repeat
    buffers = F.col("value").cast("struct<n:bigint,nb:bigint,_signal_ts:timestamp,_signal_offset:bigint>")
    totals = state.select("key.*", buffers.alias("_v")).select(*WINDOW_KEYS, "_v.*")
    return totals_to_signals(totals, trending, bot)


def signal_records(signals: DataFrame) -> DataFrame:
    """Signals as keyed records for the signals topic: key = title or "global".

    Record time and offset are those of the last edit that went into the signal (from the stream's
    aggregates, or the batch operators' ``emitted``); without them, the time of writing."""
    have = set(signals.columns)
    ts, offset = F.current_timestamp(), F.lit(None).cast("bigint")
    if "_signal_ts" in have:
        ts = F.col("_signal_ts")
        offset = F.col("_signal_offset") if "_signal_offset" in have else offset
    elif "emitted" in have:
        parts = signals.schema["emitted"].dataType.names
        ts = F.col("emitted.record_ts") if "record_ts" in parts else ts
        offset = F.col("emitted.offset") if "offset" in parts else offset
    return encode_signals(signals).select("key", "value", ts.alias("timestamp"), F.lit(0).alias("partition"),
                                          offset.alias("offset"))


def start_detection(spark: SparkSession, records_path: str, signals_path: str, checkpoint: str,
                    trending: TrendingParams | None = TrendingParams(), bot: BotParams | None = BotParams(),
                    output_mode: str = "append", source_format: str = "parquet", trigger: dict | None = None,
                    max_files_per_trigger: int | None = None, state_store: str | None = "rocksdb",
                    time_source: str = "record", name: str | None = None, sink_format: str = "parquet",
                    sink_options: dict | None = None, **source_options):
    """Start the detection query: event records in, signal records out. Append mode
    writes through the exactly-once file sink; update mode writes one folder per
    micro-batch (a committed batch is not written again). ``sink_format="kafka"`` publishes to
    the topic ``signals_path`` in either mode, with ``sink_options`` for the connector.
    ``source_format="edits"`` reads the decoded edits landed by the ingest instead of
    the JSON records: column pruning, no JSON parsing."""
    if sink_format == "kafka" and not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the classpath; write the signals as files")
    if max_files_per_trigger:
        source_options["maxFilesPerTrigger"] = max_files_per_trigger
    if source_format == "edits":
        edits = read_landed_edits(spark, records_path, streaming=True, time_source=time_source, **source_options)
    else:
        records = read_event_records(spark, records_path, fmt=source_format, streaming=True, **source_options)
        edits = records_to_edits(records, mode="strict", time_source=time_source)
    signals = detection_stream(edits, trending, bot)
    out = signal_records(signals)
    if output_mode == "append" or sink_format == "kafka":
        # the file sink is exactly-once through its own metadata log (no per-batch folders)
        writer = stream_records(out, signals_path, checkpoint, fmt=sink_format, output_mode=output_mode,
                                **(sink_options or {}))
    else:
        # update mode: the file sink cannot take it; each micro-batch has a folder of its own
        writer = (out.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
                  .foreachBatch(lambda df, bid: write_batch_partition(df, bid, signals_path, sink_format)))
    if name:
        writer = writer.queryName(name)
    with session_confs(spark, {**DETECTION_CONFS, **state_confs(state_store)}):
        return start(writer, trigger)


def run_detection(spark: SparkSession, *args, timeout_s: float | None = None, **kwargs):
    return await_done(start_detection(spark, *args, **kwargs), timeout_s)
