"""Ingest counters: published / filtered / failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INGEST_METRICS = "ingest_counts"


def ingest_count_columns() -> list[Column]:
    """Over the output of ``decode_events`` (permissive): ``published`` = decoded
    main-namespace events, ``filtered`` = decoded other namespaces, ``failed`` =
    undecodable payloads."""
    ok = ~F.col("_malformed")
    main = F.coalesce(F.col("namespace"), F.lit(0)) == 0
    return [F.count_if(ok & main).alias("published"), F.count_if(ok & ~main).alias("filtered"),
            F.count_if(~ok).alias("failed")]


def ingest_counts(decoded: DataFrame) -> DataFrame:
    """One row of counts: one global aggregate (partial per partition, tiny final merge)."""
    return decoded.agg(*ingest_count_columns())


def observe_ingest_counts(decoded: DataFrame, name: str = INGEST_METRICS) -> DataFrame:
    """Same counts as named observed metrics: no extra job; in a stream they appear per
    micro-batch in ``query.lastProgress["observedMetrics"][name]``."""
    return decoded.observe(name, *ingest_count_columns())


def counts_path(records_path: str) -> str:
    """Where an ingest lands its counters: one row per micro-batch beside the records."""
    return f"{records_path.rstrip('/')}_counts"


def landed_counts(spark: SparkSession, records_path: str) -> DataFrame:
    """One row: the counters of an ingest since it began, over all its micro-batches and restarts."""
    rows = spark.read.schema("published bigint, filtered bigint, failed bigint").parquet(counts_path(records_path))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("published", "filtered", "failed")])
