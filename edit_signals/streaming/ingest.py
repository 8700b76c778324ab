"""Ingest: captured feed lines -> decoded main-namespace event records (+ quarantine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codec import decode_events, encode_events, split_malformed
from ..operators.counters import counts_path, ingest_counts, observe_ingest_counts
from ..operators.filters import key_by_title, main_namespace
from ..sinks import write_records
from ..sources.records import _RANK_BITS, _TASK_BITS, kafka_available
from ..sources.sse import FEED_POSITION, read_sse_lines
from .common import await_done, is_committed, start, write_batch_partition
from .landed import commit_batch, compact_landed


def landed_edits(decoded: DataFrame, time_source: str = "payload") -> DataFrame:
    """Decoded main-namespace events with their record key, time and position
    (``offset`` orders records inside one landed batch as their feed lines arrived)."""
    good, _ = split_malformed(decoded)
    ts = F.timestamp_seconds(F.col("timestamp")) if time_source == "payload" else F.current_timestamp()
    placed = main_namespace(_with_offset(good))
    return key_by_title(placed).select(
        *S.EVENT_FIELDS, "key", ts.alias("record_ts"), F.lit(0).alias("partition"), "offset")


# Input splits are ranked inside spans of so many seconds of file time, and over the spans.
RANK_SECONDS = 60


def split_ranks(splits: DataFrame, seconds: int = RANK_SECONDS) -> DataFrame:
    """``_rank`` of every input split by (file time, file, start), from 0.

    Two levels: inside a span of file time, and the number of splits in earlier spans, so that a batch of millions
    of splits is not one task. Both tables have a row per split or per span at most."""
    time = FEED_POSITION[0]
    spans = splits.withColumn("_span", F.floor(F.unix_seconds(time) / F.lit(seconds)))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("_n")).select(
        "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(*FEED_POSITION)).cast("bigint") - 1
    return spans.withColumn("_inside", inside).join(before, "_span").select(
        *FEED_POSITION, (F.col("_before") + F.col("_inside")).alias("_rank"))


def _with_offset(rows: DataFrame) -> DataFrame:
    """``offset``: rank of the line's input split by (file time, file, start), then its place in it.

    Spark packs splits into tasks by size, so the task order alone is not the arrival order."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    rows = rows.withColumn("_place", place)
    if FEED_POSITION[0] not in rows.columns:
        return rows.withColumn("offset", F.monotonically_increasing_id()).drop("_place")
    splits = split_ranks(rows.select(*FEED_POSITION).distinct())
    offset = F.when(F.col("_rank") < F.lit(1 << _RANK_BITS), F.shiftleft("_rank", _TASK_BITS).bitwiseOR(F.col("_place"))
                    ).otherwise(F.raise_error(F.lit("too many input splits in one batch")).cast("bigint"))
    return rows.join(splits, list(FEED_POSITION)).withColumn("offset", offset).drop("_rank", "_place")


def records_from_decoded(decoded: DataFrame, time_source: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Decoded, main-namespace events as keyed records (key = title, value = event JSON,
    ``timestamp`` = record time) and the quarantined undecodable payloads.

    ``time_source="payload"`` stamps records with the event's own time (deterministic
    replays); ``"ingest"`` stamps them with the processing time, as a live publisher does."""
    _, bad = split_malformed(decoded)
    return _as_records(landed_edits(decoded, time_source)), bad.select("value", "payload")


def _as_records(edits: DataFrame) -> DataFrame:
    return encode_events(edits).select("key", "value", F.col("record_ts").alias("timestamp"), "partition", "offset")


def write_decoded(decoded: DataFrame, batch_id: int, records_path: str, quarantine_path: str,
                  time_source: str = "payload", edits_path: str | None = None, sink_format: str = "parquet",
                  sink_options: dict | None = None, compact_every: int | None = None) -> None:
    """One micro-batch (or one batch job): all outputs from one decode of the lines.
    ``edits_path`` also lands the decoded edits (columnar) for detection. The counters of the
    batch land beside the records; they are written last, so a counted batch is complete.

    ``sink_format="kafka"`` publishes the records to the topic ``records_path`` (at least once: a
    batch replayed after a crash is published again); counters then land beside the quarantine.

    ``compact_every`` keeps a list of the topic's live folders (``streaming.landed``) and compacts so many of one level
    into one, which bounds the number of folders; read such a topic with ``read_landed`` or ``consume_landed``."""
    spark = decoded.sparkSession
    to_topic = sink_format == "kafka"
    counts = counts_path(quarantine_path if to_topic else records_path)
    listed = [] if not compact_every else [(p, s) for p, s in (
        (None if to_topic else records_path, S.EVENT_RECORD), (edits_path, S.EDIT_TABLE)) if p]
    if is_committed(spark, counts, batch_id):
        for path, _ in listed:  # a crash may have come between the two
            commit_batch(spark, path, batch_id)
        return
    decoded = decoded.persist()
    try:
        edits = landed_edits(decoded, time_source)
        if to_topic:
            write_records(_as_records(edits), records_path, fmt=sink_format, **(sink_options or {}))
        else:
            write_batch_partition(_as_records(edits), batch_id, records_path, sink_format)
        write_batch_partition(split_malformed(decoded)[1].select("value", "payload"), batch_id, quarantine_path)
        if edits_path:
            write_batch_partition(edits, batch_id, edits_path)
        write_batch_partition(ingest_counts(decoded), batch_id, counts)
        for path, schema in listed:
            commit_batch(spark, path, batch_id)
            if (batch_id + 1) % compact_every == 0:
                compact_landed(spark, path, schema, compact_every, order=("offset",))
    finally:
        decoded.unpersist()


def start_ingest(spark: SparkSession, feed_path: str, records_path: str, quarantine_path: str,
                 checkpoint: str, max_files_per_trigger: int | None = None, trigger: dict | None = None,
                 time_source: str = "payload", name: str | None = None, edits_path: str | None = None,
                 sink_format: str = "parquet", sink_options: dict | None = None, compact_every: int | None = None):
    """Streaming ingest over a folder of captured feed files. Records land partitioned
    by micro-batch; arrival order of the landed topic is (batch_id, offset). Counters
    (published / filtered / failed) land per micro-batch (``operators.counters.landed_counts``) and
    are observed metrics of each. ``sink_format`` / ``sink_options`` / ``compact_every`` as in :func:`write_decoded`."""
    if sink_format == "kafka" and not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the classpath; land the records as files")
    options = {"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}
    decoded = observe_ingest_counts(decode_events(read_sse_lines(spark, feed_path, streaming=True, **options)))
    writer = (decoded.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: write_decoded(df, bid, records_path, quarantine_path, time_source,
                                                          edits_path, sink_format, sink_options, compact_every)))
    if name:
        writer = writer.queryName(name)
    return start(writer, trigger)


def run_ingest(spark: SparkSession, *args, timeout_s: float | None = None, **kwargs):
    return await_done(start_ingest(spark, *args, **kwargs), timeout_s)
