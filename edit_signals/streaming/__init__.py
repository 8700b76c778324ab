"""Structured Streaming queries: ingest (feed files -> records / quarantine / edits),
detection (watermarked windowed aggregates, append or update) and serving (store log and
recent-signals snapshots through ``foreachBatch``)."""

from .detect import detection_stream, open_windows, run_detection, signal_records, start_detection
from .exact import open_signals, run_exact_detection, start_exact_detection
from .ingest import run_ingest, start_ingest
from .serve import compact_store, recent_view, run_serving, start_serving, store_view

__all__ = ["detection_stream", "open_windows", "open_signals", "run_exact_detection", "start_exact_detection", "run_detection", "signal_records", "start_detection", "run_ingest", "start_ingest",
           "compact_store", "recent_view", "run_serving", "start_serving", "store_view"]
