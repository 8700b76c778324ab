"""edit_signals: wiki-edit signal detection as Spark DataFrame jobs (batch and streaming).

The public API is re-exported here; see the README for the operator map.
"""

from .functions import (decode_events, decode_signals, encode_events, encode_signals, ratio_percent,
                        signal_display, signal_html_rows, signal_keys, split_malformed, with_event_defaults)
from .operators import (bot_anomaly_filter, bot_anomaly_signals, bot_ratio, bot_revisions, detect_signals,
                        drop_late, drop_null_keys, final_signals, first_crossing, flag_late, ingest_counts,
                        key_by_title, late_rows, main_namespace, recent_signals, signal_items, signal_revisions,
                        signals_json, to_bot_signal, to_trending_signal, trending_filter, trending_revisions,
                        trending_signals, tumbling, tumbling_bot_counts, tumbling_edit_counts, upsert_signals,
                        with_event_time)
from .params import Arrival, BotParams, TrendingParams
from .session import build_session, prepare
from .sinks import stream_records, write_event_records, write_records, write_signal_records
from .sources import (FILE_ARRIVAL, MERGED_ARRIVAL, PARTITION_ARRIVAL, read_event_records, read_signal_records,
                      read_sse_lines, records_to_edits, sse_payloads)
from .sources.records import read_landed_edits

__all__ = [n for n in dir() if not n.startswith("_")]
