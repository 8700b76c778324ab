"""DataFrame -> DataFrame operators (batch; most are valid on streaming DataFrames too)."""

from .counters import ingest_counts, landed_counts
from .filters import drop_null_keys, key_by_title, main_namespace, with_event_time
from .lateness import apply_late, closing_arrivals, drop_late, first_arrivals, flag_late, flag_late_by, late_rows
from .report import recent_signals, signals_json
from .revisions import bot_revisions, first_crossing, running_totals, signal_revisions, trending_revisions
from .signals import (bot_anomaly_filter, bot_anomaly_signals, detect_signals, final_signals, shared_detect,
                      to_bot_signal,
                      to_trending_signal, trending_filter, trending_signals)
from .store import signal_items, upsert_signals
from .windows import bot_ratio, tumbling, tumbling_bot_counts, tumbling_edit_counts

__all__ = [n for n in dir() if not n.startswith("_")]
