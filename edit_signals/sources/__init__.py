"""Sources: captured SSE feeds, keyed record topics, and the driver's tables."""

from .events_table import edits, raw_edits, read_edits, read_table, sse_lines
from .records import (FILE_ARRIVAL, MERGED_ARRIVAL, PARTITION_ARRIVAL, arrival_orders, kafka_available, read_event_records, read_signal_records,
                      records_to_edits, with_clock)
from .sse import read_sse_lines, sse_payloads

__all__ = [
    "edits", "raw_edits", "read_edits", "read_table", "sse_lines", "FILE_ARRIVAL", "MERGED_ARRIVAL", "PARTITION_ARRIVAL",
    "arrival_orders", "with_clock",
    "kafka_available", "read_event_records", "read_signal_records", "records_to_edits", "read_sse_lines",
    "sse_payloads",
]
