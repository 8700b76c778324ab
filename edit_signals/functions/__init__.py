"""Column-level functions: JSON codecs, store keys and display formatting."""

from .codec import (decode_events, decode_signals, encode_events, encode_signals, split_malformed,
                    with_event_defaults)
from .display import ratio_percent, signal_display, signal_html_rows
from .keys import signal_keys

__all__ = [
    "decode_events", "decode_signals", "encode_events", "encode_signals", "split_malformed",
    "with_event_defaults", "ratio_percent", "signal_display", "signal_html_rows", "signal_keys",
]
