"""Captured SSE feed: text lines -> JSON payloads (batch or streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed line prefixes of an SSE data line.
DATA_PREFIX_SPACED = "data: "
DATA_PREFIX = "data:"


def sse_payloads(lines: DataFrame, col: str = "value") -> DataFrame:
    """Keep ``data:`` lines and strip the prefix (``"data: "`` then ``"data:"``); comments,
    ``event:``, ``id:`` and blank lines are ignored. One line is one payload."""
    v = F.col(col)
    payload = (F.when(v.startswith(DATA_PREFIX_SPACED), F.substr(v, F.lit(len(DATA_PREFIX_SPACED) + 1)))
               .otherwise(F.substr(v, F.lit(len(DATA_PREFIX) + 1))))
    return lines.filter(v.startswith(DATA_PREFIX)).withColumn("payload", payload)


# Where a line of a captured feed stands: file time, file, start of the input split.
FEED_POSITION = ("_feed_time", "_feed_file", "_feed_start")


def read_sse_lines(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Captured feed files (UTF-8 text, one SSE line per row) -> ``value``, ``payload`` and the
    columns of :data:`FEED_POSITION`."""
    reader = spark.readStream if streaming else spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    meta = ("file_modification_time", "file_path", "file_block_start")
    return sse_payloads(reader.text(path).select(
        "value", *[F.col(f"_metadata.{m}").alias(c) for m, c in zip(meta, FEED_POSITION)]))
