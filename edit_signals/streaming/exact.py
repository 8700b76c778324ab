"""Exact zero-grace detection in a stream: lateness per record, every update a signal.

Spark's watermark judges lateness per micro-batch. Here a micro-batch carries over what exactness needs, in a
small versioned table: the highest record time seen (per clock scope) and, per open window, its running totals.
A record is late if its window had ended by that time before the batch, or by an earlier record of
the batch (the batch operator's shared panes decide that); totals inside the batch start from the carried ones. So
the rows do not depend on where the input is cut into micro-batches: they are those of the batch
operators ``signal_revisions`` and ``detect_signals(late="drop")`` over all records.

All work on records is the batch operators' (no per-row Python). The state holds open windows only: a window
leaves when the clock passes its end, which is when its final signal is emitted. Each version is a folder
``version=<batch id>``, written after the outputs of its batch; a replayed batch that has its version is skipped, one
that was cut short is written again from the version before. The newest two versions stay.

The arrival order (offset in a partition, or (batch, offset) of ingest folders) must continue over the
micro-batches, as it does for both sources. Both detectors need one clock; over a keyed topic of several
partitions (:data:`..sources.records.PARTITION_ARRIVAL`) the trending detector runs with a clock per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrival import arrival_key
from ..operators.lateness import flag_late_by, pane_start
from ..operators.revisions import _two_scans, group_columns
from ..operators.signals import bots_dominate, trends
from ..operators.windows import bot_ratio, is_bot
from ..params import BOT_ANOMALY, GLOBAL_KEY, TRENDING, Arrival, BotParams, TrendingParams, window_micros
from ..sources.records import LOG_ARRIVAL, read_event_records, read_landed_edits, records_to_edits
from .common import await_done, latest_version, retain_versions, start, version_folder, version_is_committed, write_batch_partition
from .detect import signal_records

EMITS = ("updates", "final")


def _windows(trending: TrendingParams | None, bot: BotParams | None) -> Column:
    """Width (microseconds) of a row's window, by ``signal_type``."""
    if bot is None or trending is None:
        return F.lit(window_micros((trending or bot).window))
    return F.when(F.col("signal_type") == TRENDING, F.lit(window_micros(trending.window))).otherwise(
        F.lit(window_micros(bot.window)))


def accepted_totals(edits: DataFrame, trending: TrendingParams | None, bot: BotParams | None, arrival: Arrival,
                    mark: str) -> DataFrame:
    """Per group, ``_n`` and ``_nb`` of the records its window accepts and where the last of them stands."""
    late = {f"_late_{i}": p.window for i, p in enumerate((trending, bot)) if p is not None}
    flagged = flag_late_by(edits, late, arrival)
    carry = [*arrival.partitions, mark, "_bot", "_key", *[f"_em_{c}" for c in arrival.emitted_columns]]
    flagged = flagged.withColumns({"_bot": is_bot().cast("bigint"), "_key": arrival_key(edits, arrival),
                                   **{f"_em_{c}": F.col(c) for c in arrival.emitted_columns}})
    branches = []
    for i, (kind, p) in enumerate(((TRENDING, trending), (BOT_ANOMALY, bot))):
        if p is not None:
            title = F.col("title") if kind == TRENDING else F.lit("")
            branches.append(F.struct(F.lit(kind).alias("signal_type"), pane_start(window_micros(p.window)).alias("_ws"),
                                     title.alias("_g_title"), F.col(f"_late_{i}").alias("_late"), *[F.col(c) for c in carry]))
    rows = flagged.select(F.explode(F.array(*branches)).alias("_r")).select("_r.*").filter(
        F.col("_ws").isNotNull() & F.col("_g_title").isNotNull() & ~F.col("_late")
        & (F.col(mark).isNull() | (F.col("_ws") + _windows(trending, bot) > F.col(mark))))
    return rows.groupBy(*group_columns(arrival)).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_bot").alias("_nb"),
        *[F.max_by(F.col(f"_em_{c}"), F.col("_key")).alias(f"_em_{c}") for c in arrival.emitted_columns])


def as_signals(totals: DataFrame, trending: TrendingParams | None, bot: BotParams | None, arrival: Arrival) -> DataFrame:
    """Windows with their totals that pass their detector, as signals."""
    is_tr, ratio = F.col("signal_type") == TRENDING, bot_ratio(F.col("_nb"), F.col("_n"))
    keep = F.lit(False)
    if trending is not None:
        keep = keep | (is_tr & trends(F.col("_n"), trending.threshold))
    if bot is not None:
        keep = keep | (~is_tr & bots_dominate(F.col("_n"), ratio, bot.ratio_threshold, bot.min_volume))
    title = F.when(is_tr, F.col("_g_title"))
    return totals.filter(keep).select(
        "signal_type", title.alias("title"), F.when(is_tr, F.col("_n")).alias("edit_count"),
        F.when(~is_tr, F.col("_nb")).alias("bot_edit_count"), F.when(~is_tr, F.col("_n")).alias("total_edit_count"),
        F.when(~is_tr, ratio).alias("ratio"), F.timestamp_micros("_ws").alias("window_start"),
        F.timestamp_micros(F.col("_ws") + _windows(trending, bot)).alias("window_end"),
        F.when(is_tr, title).otherwise(F.lit(GLOBAL_KEY)).alias("key"),
        F.struct(*[F.col(f"_em_{c}").alias(c) for c in arrival.emitted_columns]).alias("emitted"))


def exact_batch(edits: DataFrame, batch_id: int, signals_path: str, state_path: str, trending: TrendingParams | None,
                bot: BotParams | None, arrival: Arrival = LOG_ARRIVAL, emit: str = "updates") -> None:
    """One micro-batch: its signals, then the state after it."""
    spark, scope = edits.sparkSession, list(arrival.partitions)
    if version_is_committed(spark, f"{state_path}/clock", batch_id):
        return
    before = latest_version(spark, f"{state_path}/clock", batch_id)
    edits = edits.persist()
    try:
        carried = clock = None
        marked = edits.withColumn("_mark", F.lit(None).cast("bigint"))
        if before is not None:
            carried = spark.read.parquet(version_folder(f"{state_path}/totals", before))
            clock = spark.read.parquet(version_folder(f"{state_path}/clock", before))
            if scope:
                marked = edits.join(clock.withColumnRenamed("mark", "_mark"), scope, "left")
            else:
                seen = clock.first()  # one row: the only clock
                marked = edits.withColumn("_mark", F.lit(seen["mark"] if seen else None).cast("bigint"))
        if emit == "updates":
            updates = _two_scans(marked, trending, bot, arrival, "drop", carried=carried, mark="_mark")
            write_batch_partition(signal_records(updates), batch_id, signals_path)
        marks = edits.groupBy(*scope).agg(F.max(F.unix_micros(F.col("event_time").cast("timestamp"))).alias("mark"))
        if clock is not None:
            marks = marks.unionByName(clock).groupBy(*scope).agg(F.max("mark").alias("mark"))
        totals = accepted_totals(marked, trending, bot, arrival, "_mark").withColumn("_batch", F.lit(batch_id).cast("bigint"))
        if carried is not None:
            ems = [f"_em_{c}" for c in arrival.emitted_columns]
            totals = totals.unionByName(carried).groupBy(*group_columns(arrival)).agg(
                F.sum("_n").alias("_n"), F.sum("_nb").alias("_nb"), *[F.max_by(c, "_batch").alias(c) for c in ems],
                F.max("_batch").alias("_batch"))
        now = marks.withColumnRenamed("mark", "_now")
        ended = (totals.join(now, scope, "left") if scope else totals.join(F.broadcast(now))).withColumn(
            "_ended", F.coalesce(F.col("_ws") + _windows(trending, bot) <= F.col("_now"), F.lit(False)))
        ended = ended.drop("_now").persist()
        try:
            if emit == "final":
                closed = as_signals(ended.filter("_ended"), trending, bot, arrival)
                write_batch_partition(signal_records(closed), batch_id, signals_path)
            ended.filter("NOT _ended").drop("_ended").write.mode("overwrite").parquet(
                version_folder(f"{state_path}/totals", batch_id))
            marks.write.mode("overwrite").parquet(version_folder(f"{state_path}/clock", batch_id))  # commits the batch
        finally:
            ended.unpersist()
        for table in ("totals", "clock"):
            retain_versions(spark, f"{state_path}/{table}", batch_id)
    finally:
        edits.unpersist()


def open_signals(spark: SparkSession, state_path: str, trending: TrendingParams | None, bot: BotParams | None,
                 arrival: Arrival = LOG_ARRIVAL) -> DataFrame | None:
    """Signals of the windows that are still open, from the newest state; None before the first batch."""
    last = latest_version(spark, f"{state_path}/clock", 2 ** 62)
    if last is None:
        return None
    return as_signals(spark.read.parquet(version_folder(f"{state_path}/totals", last)), trending, bot, arrival)


def start_exact_detection(spark: SparkSession, records_path: str, signals_path: str, state_path: str, checkpoint: str,
                          trending: TrendingParams | None = TrendingParams(), bot: BotParams | None = BotParams(),
                          arrival: Arrival = LOG_ARRIVAL, emit: str = "updates", source_format: str = "parquet",
                          trigger: dict | None = None, max_files_per_trigger: int | None = None, time_source: str = "record",
                          offsets_per_bucket: int = 1_000_000, name: str | None = None, **source_options):
    """Start exact detection: event records in, signal records out. ``emit="updates"`` writes every update that passes
    (as the batch ``signal_revisions``), ``"final"`` each window once, when it closes; the windows still open
    are :func:`open_signals`. ``source_format="edits"`` reads decoded edits landed by the ingest."""
    if emit not in EMITS:
        raise ValueError(f"emit must be one of {EMITS}, got {emit!r}")
    if trending is None and bot is None:
        raise ValueError("a detector is needed")
    if arrival.partitions and bot is not None:
        raise ValueError("bot windows span the input partitions: their arrival order needs one clock")
    if max_files_per_trigger:
        source_options["maxFilesPerTrigger"] = max_files_per_trigger
    if source_format == "edits":
        edits = read_landed_edits(spark, records_path, streaming=True, time_source=time_source,
                                  offsets_per_bucket=offsets_per_bucket, **source_options)
    else:
        records = read_event_records(spark, records_path, fmt=source_format, streaming=True, **source_options)
        edits = records_to_edits(records, mode="strict", time_source=time_source, offsets_per_bucket=offsets_per_bucket)
    needed = ["title", "bot", "event_time", *arrival.partitions, *arrival.order, *arrival.emitted_columns, arrival.bucket]
    writer = (edits.select(*dict.fromkeys(needed)).writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: exact_batch(df, bid, signals_path, state_path, trending, bot, arrival, emit)))
    if name:
        writer = writer.queryName(name)
    return start(writer, trigger)


def run_exact_detection(spark: SparkSession, *args, timeout_s: float | None = None, **kwargs):
    return await_done(start_exact_detection(spark, *args, **kwargs), timeout_s)
