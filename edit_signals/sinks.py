"""Record sinks (events topic, signals topic): Kafka when its connector is present,
else Parquet/JSON files with the same key/value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .sources.records import kafka_available


def _require_kafka(df: DataFrame) -> None:
    if not kafka_available(df.sparkSession):
        raise RuntimeError("the Kafka connector is not on the classpath; write files instead")


def write_records(records: DataFrame, target: str, fmt: str = "parquet", mode: str = "append", **options) -> None:
    """Batch write of keyed records (``key``, ``value`` and optional ``timestamp``)."""
    if fmt == "kafka":
        _require_kafka(records)
        records.selectExpr("key", "value").write.format("kafka").option("topic", target).options(**options).save()
        return
    records.write.mode(mode).format(fmt).options(**options).save(target)


def stream_records(records: DataFrame, target: str, checkpoint: str, fmt: str = "parquet",
                   output_mode: str = "append", **options):
    """Streaming writer of keyed records; call ``.trigger(...).start()`` on the result.
    File sinks are exactly-once (the sink log lives next to the data)."""
    if fmt == "kafka":
        _require_kafka(records)
        records = records.selectExpr("key", "value")
    w = records.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).options(**options)
    if fmt == "kafka":
        return w.format("kafka").option("topic", target)
    return w.format(fmt).option("path", target)


write_event_records = write_records
write_signal_records = write_records
