"""Adapter: the driver's ``events`` table seen as a feed of wiki edits.

Every rule below is mirrored one-to-one by the DuckDB oracle in
``plans/oracles.py``; change both or neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import with_event_defaults

# Fixed adapter rules (shared with the oracle SQL).
LATE_SHIFT = "INTERVAL 6 HOURS"      # rows with k >= 90 arrive six hours after their event time
BROKEN_K = (95, 99)                  # these rows become malformed feed lines
NULL_TITLE_K = 7                     # title absent
NO_BOT_FLAG_K = 3                    # "bot" absent -> false
NO_NAMESPACE_K = 4                   # "namespace" absent -> 0
TALK_NAMESPACE_K = (80, 89)          # namespace 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over the cores when the input has fewer partitions than that
    (a small table stored as one row group is read by one task). Inputs with enough
    splits are returned unchanged, so at scale this adds no shuffle."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. a remote session): leave the plan as is
        return df
    return df.repartition(target) if splits < target else df


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def raw_edits(events: DataFrame) -> DataFrame:
    """Edit fields exactly as the feed would carry them (absent fields are NULL)."""
    from ..functions.codec import parse_once
    k = F.col("_k")
    return (
        events.select("*", parse_once(_k()).alias("_k"))
        .select(
            F.when(k == NULL_TITLE_K, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("title"),
            F.when(k % 2 == 0, F.lit("enwiki")).otherwise(F.lit("dewiki")).alias("wiki"),
            F.concat(F.lit("editor_"), F.col("user_id").cast("string")).alias("user"),
            F.when(k == NO_BOT_FLAG_K, F.lit(None).cast("boolean"))
            .otherwise(F.col("event_type") != F.lit("click")).alias("bot"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
            F.col("event_type").alias("type"),
            F.col("props").alias("comment"),
            F.when(k == NO_NAMESPACE_K, F.lit(None).cast("int"))
            .when(k.between(*TALK_NAMESPACE_K), F.lit(1))
            .otherwise(F.lit(0)).alias("namespace"),
            F.struct(F.col("event_id").alias("old"), (F.col("event_id") + 1).alias("new")).alias("revision"),
            F.struct((k * 10).cast("int").alias("old"),
                     (k * 10 + F.col("user_id") % 50).cast("int").alias("new")).alias("length"),
            F.col("event_id"),
            k.alias("k"),
            F.col("ts").cast("timestamp").alias("event_time"),
            F.when(k >= 90, F.col("ts").cast("timestamp") + F.expr(LATE_SHIFT))
            .otherwise(F.col("ts").cast("timestamp")).alias("arrival_ts"),
        )
    )


def with_arrival_bucket(df: DataFrame, bucket_seconds: int = 60, ts_col: str = "arrival_ts") -> DataFrame:
    """Ordered sub-range of arrival used to split hot groups (see ``params.Arrival``)."""
    return df.withColumn("arrival_bucket", F.floor(F.unix_seconds(F.col(ts_col)) / F.lit(bucket_seconds)))


def edits(events: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """Decoded edits with defaults applied, event time and arrival order.

    Columns: the event fields, ``event_id``, ``k``, ``event_time`` (record time),
    ``arrival_ts`` / ``arrival_id`` (arrival order) and ``arrival_bucket``.
    """
    df = with_event_defaults(raw_edits(events)).withColumn("arrival_id", F.col("event_id"))
    return with_arrival_bucket(df, bucket_seconds)


def read_edits(spark: SparkSession, sf_dir: str, bucket_seconds: int = 1) -> DataFrame:
    return edits(read_table(spark, sf_dir, "events"), bucket_seconds)


# Fixed SSE framing lines (one captured frame per event).
SSE_EVENT_LINE = "event: message"
SSE_COMMENT_LINE = ": keep-alive"


def sse_lines(events: DataFrame) -> DataFrame:
    """Captured SSE text derived from ``events``: one frame of lines per event.

    Frames carry ``event:``, ``id:``, ``data:`` (with or without the space) and a blank
    separator; every tenth event adds a comment line; rows with k in 95..99 carry
    a truncated JSON payload. Columns: ``value`` (the line), ``event_id``, ``line_no``.
    """
    return sse_frames(spread(events))  # JSON encoding of every event: use all cores


def sse_frames(events: DataFrame) -> DataFrame:
    """:func:`sse_lines` of events that are spread over the cores already."""
    from ..functions.codec import encode_feed_json

    raw = raw_edits(events)
    k = F.col("k")
    payload = (
        F.when(k.between(*BROKEN_K),
               F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"title":')))
        .otherwise(encode_feed_json(raw))
    )
    data_line = F.when(k % 3 == 0, F.concat(F.lit("data:"), payload)).otherwise(F.concat(F.lit("data: "), payload))
    frame = F.array(
        F.lit(SSE_EVENT_LINE),
        F.concat(F.lit("id: "), F.col("event_id").cast("string")),
        data_line,
        F.lit(""),
    )
    frame = F.when(F.col("event_id") % 10 == 0, F.array_insert(frame, 1, F.lit(SSE_COMMENT_LINE))).otherwise(frame)
    return raw.select("event_id", F.posexplode(frame).alias("line_no", "value"))
