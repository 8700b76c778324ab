"""Keyed record topics (events, signals): Kafka when its connector is on the classpath,
else files with the same columns (key, value, timestamp, partition, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codec import decode_events, split_malformed
from ..operators.filters import with_event_time
from ..params import Arrival


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001 - connector absent or no JVM access
        return False


def _read(spark: SparkSession, path_or_topic: str, fmt: str, streaming: bool, options: dict) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        if not kafka_available(spark):
            raise RuntimeError("the Kafka connector is not on the classpath; land the topic as files")
        opts = {"subscribe": path_or_topic, "startingOffsets": "earliest", **options}
        df = reader.format("kafka").options(**opts).load()
        return df.select(F.col("key").cast("string"), F.col("value").cast("string"),
                         F.col("timestamp").alias("record_ts"), "partition", "offset")
    df = reader.format(fmt).schema(S.EVENT_RECORD).options(**options).load(path_or_topic)
    return df.withColumnRenamed("timestamp", "record_ts")


def with_file_position(records: DataFrame, fmt: str = "parquet") -> DataFrame:
    """``file_position`` of records read from files: (file time, file, row); null for other sources."""
    if fmt != "parquet":
        return records.withColumn("file_position", F.lit(None).cast("struct<time:timestamp,file:string,row:bigint>"))
    return records.withColumn("file_position", F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row")))


def read_event_records(spark: SparkSession, path_or_topic: str, fmt: str = "parquet", streaming: bool = False,
                       **options) -> DataFrame:
    """Event records: ``key`` (title), ``value`` (event JSON), ``record_ts``, ``partition``, ``offset``."""
    return _read(spark, path_or_topic, fmt, streaming, options)


def read_signal_records(spark: SparkSession, path_or_topic: str, fmt: str = "parquet", streaming: bool = False,
                        **options) -> DataFrame:
    """Signal records, read from the earliest offset. Resume position lives in the
    streaming query's checkpoint."""
    return _read(spark, path_or_topic, fmt, streaming, options)


_EMITTED = ("record_ts", "partition", "offset")
# Arrival order of record topics. Keyed (trending) state has a clock per input partition. The bot
# branch merges the partitions: a record cannot overtake an earlier one of its partition, so it
# arrives when the running maximum of its partition's record times says (``clock``, see with_clock).
PARTITION_ARRIVAL = Arrival(order=("offset",), partitions=("partition",), bucket="offset_bucket", emitted=_EMITTED)
MERGED_ARRIVAL = Arrival(order=("clock", "partition", "offset"), bucket="clock_bucket", split=("partition",),
                         emitted=_EMITTED)
# A topic with one partition, or any single ordered log: one clock for both detectors.
LOG_ARRIVAL = Arrival(order=("offset",), bucket="offset_bucket", emitted=_EMITTED)
# Topics landed as files by the ingest job: one folder per micro-batch, ``offset`` increasing
# inside it; buckets = (batch, feed split) so one large batch is still split.
FILE_ARRIVAL = Arrival(order=("batch_id", "offset"), partitions=(), bucket="file_bucket",
                       emitted=("record_ts", "batch_id", "offset"))
# Landed offsets keep the feed split's rank above bit 33. That leaves 30 bits for the rank, so buckets of
# (batch, rank) are as many apart per batch and never overlap.
_TASK_BITS = 33
_RANK_BITS = 63 - _TASK_BITS


def with_clock(edits: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """Adds ``clock``: the running maximum of ``record_ts`` along a partition's offsets, and
    ``clock_bucket``. Two levels: inside (partition, offset bucket) and over a partition's buckets."""
    before = Window.partitionBy("partition").orderBy("offset_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = edits.groupBy("partition", "offset_bucket").agg(F.max("record_ts").alias("_top")).select(
        "partition", "offset_bucket", F.max("_top").over(before).alias("_before"))
    upto = (Window.partitionBy("partition", "offset_bucket").orderBy("offset")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = edits.join(base, ["partition", "offset_bucket"]).withColumn(
        "clock", F.greatest("_before", F.max("record_ts").over(upto))).drop("_before")
    return out.withColumn("clock_bucket", F.floor(F.unix_seconds("clock") / F.lit(bucket_seconds)))


def arrival_orders(edits: DataFrame) -> tuple[Arrival, Arrival]:
    """(trending, bot) arrival orders the source supports: folders of an ingest, or a keyed topic."""
    return (FILE_ARRIVAL, FILE_ARRIVAL) if "batch_id" in edits.columns else (PARTITION_ARRIVAL, MERGED_ARRIVAL)


def records_to_edits(records: DataFrame, mode: str = "strict", time_source: str = "record",
                     offsets_per_bucket: int = 1_000_000, bucket_seconds: int = 1) -> DataFrame:
    """Decode record values (``strict``: a bad value fails the job, as the detector does;
    ``permissive``: bad values are dropped) and add ``event_time`` plus the arrival
    columns used by :data:`PARTITION_ARRIVAL` / :data:`FILE_ARRIVAL` (:func:`with_clock` adds those
    of :data:`MERGED_ARRIVAL`)."""
    dec = decode_events(records, payload="value", mode=mode)
    if mode == "permissive":
        dec = split_malformed(dec)[0]
    return with_arrival_columns(dec, time_source, offsets_per_bucket)


def read_landed_edits(spark: SparkSession, path: str, streaming: bool = False, time_source: str = "record",
                      offsets_per_bucket: int = 1_000_000, **options) -> DataFrame:
    """Edits landed by the ingest (``edits_path``): decoded columns, no JSON to parse, so
    a detection query reads only title / bot / record time / position."""
    reader = spark.readStream if streaming else spark.read
    df = reader.format("parquet").schema(S.EDIT_TABLE).options(**options).load(path)
    return with_arrival_columns(df, time_source, offsets_per_bucket)


def with_arrival_columns(dec: DataFrame, time_source: str = "record", offsets_per_bucket: int = 1_000_000) -> DataFrame:
    dec = with_event_time(dec, time_source, record_col="record_ts")
    cols = {
        "offset_bucket": F.floor(F.col("offset") / F.lit(offsets_per_bucket)),
    }
    if "batch_id" in dec.columns:
        batch = F.col("batch_id").cast("bigint")
        fits = batch.isNull() | F.col("offset").isNull() | ((F.col("offset") >= 0) & batch.between(0, (1 << _TASK_BITS) - 1))
        cols["file_bucket"] = F.when(fits, F.shiftleft(batch, _RANK_BITS).bitwiseOR(F.shiftright(F.col("offset"), _TASK_BITS))
                                     ).otherwise(F.raise_error(F.lit("batch id or offset out of range")).cast("bigint"))
    return dec.withColumns(cols)
