"""Helpers shared by the operators: landed tables, Arrow batches, label folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare as _prepare
from ..session import scratch_path

# Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """UTC session with bounded Arrow batches."""
    _prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared work folder and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs no recomputation
    of earlier steps, and statistics of the landed files drive later join planning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``None`` or no rows emits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if isinstance(out, pa.Table):
                yield from (b for b in out.to_batches() if b.num_rows)
            elif out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def held_out(doc_id: str = "doc_id") -> Column:
    """Evaluation fold: crc32 of the id as text, modulo 3, is 1 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
