"""The three stages as batch jobs over landed data (same operators as the streams).

ingest:  captured feed files -> event records + quarantine (+ counters)
detect:  event records -> signals (final per window, or every revision), exact lateness
serve:   signal records -> keyed store table, newest-N report, JSON array, HTML rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Observation

from ..functions.codec import decode_events, decode_signals
from ..functions.display import signal_display, signal_html_rows
from ..operators.counters import ingest_count_columns
from ..operators.report import recent_signals, signals_json
from ..operators.revisions import signal_revisions
from ..operators.signals import detect_signals
from ..operators.store import upsert_signals
from ..params import RECENT_SIGNALS, BotParams, TrendingParams
from ..session import prepare
from ..sinks import write_records
from ..sources.records import (MERGED_ARRIVAL, arrival_orders, read_event_records, read_landed_edits,
                               read_signal_records, records_to_edits, with_clock, with_file_position)
from ..sources.sse import read_sse_lines
from ..streaming.detect import signal_records
from ..streaming.ingest import write_decoded
from ..streaming.serve import arrived


def ingest_feed(spark: SparkSession, feed_path: str, records_path: str, quarantine_path: str,
                time_source: str = "payload", batch_id: int = 0, edits_path: str | None = None) -> dict[str, int]:
    """Batch ingest; returns the counters (observed while writing, no extra pass). A batch id that
    is committed already is not written again."""
    prepare(spark)
    obs = Observation("ingest_counts")
    decoded = decode_events(read_sse_lines(spark, feed_path)).observe(obs, *ingest_count_columns())
    write_decoded(decoded, batch_id, records_path, quarantine_path, time_source, edits_path)
    return {k: int(v) for k, v in obs.get.items()}


def detect_from_records(spark: SparkSession, records_path: str, trending: TrendingParams = TrendingParams(),
                        bot: BotParams = BotParams(), late: str = "drop", revisions: bool = False,
                        arrival=None, source_format: str = "parquet", bot_arrival=None) -> DataFrame:
    """Signals from landed event records. ``late="drop"`` applies the exact zero-grace
    lateness in arrival order; ``revisions=True`` emits every update instead of the
    final state of each window. The arrival orders default to those of the source: ingest
    folders by (batch, offset), topics by a clock per partition for the keyed branch and the
    merge of the partitions for the bot branch."""
    prepare(spark)
    if source_format == "edits":
        edits = read_landed_edits(spark, records_path)
    else:
        edits = records_to_edits(read_event_records(spark, records_path, fmt=source_format), mode="strict")
    trending_order, bot_order = arrival_orders(edits)
    arrival, bot_arrival = arrival or trending_order, bot_arrival or arrival or bot_order
    if MERGED_ARRIVAL in (arrival, bot_arrival):
        edits = with_clock(edits)
    if revisions:
        return signal_revisions(edits, trending, bot, arrival, late=late, bot_arrival=bot_arrival)
    return detect_signals(edits, trending, bot, arrival=arrival, late=late, bot_arrival=bot_arrival)


def publish_signals(signals: DataFrame, signals_path: str, fmt: str = "parquet") -> None:
    write_records(signal_records(signals), signals_path, fmt=fmt)


def serve_signals(spark: SparkSession, signals_path: str, store_path: str, key: str = "window",
                  n: int = RECENT_SIGNALS, source_format: str = "parquet") -> dict[str, DataFrame]:
    """Store table (written, last write wins per key) and the report frames, in the arrival
    order of the signal records (see ``streaming.serve.arrived``)."""
    prepare(spark)
    recs = with_file_position(read_signal_records(spark, signals_path, fmt=source_format), source_format)
    signals = arrived(decode_signals(recs))
    store = upsert_signals(signals, order=("emitted",), key=key)
    store.write.mode("overwrite").parquet(store_path)
    recent = recent_signals(signals, n)
    return {"store": spark.read.parquet(store_path), "recent": recent, "json": signals_json(recent, n),
            "html": signal_html_rows(signal_display(recent))}
