"""Detection parameters. Defaults are the reference's configuration defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Fixed values that must equal the reference's defaults.
DEFAULT_TRENDING_WINDOW_MINUTES = 5
DEFAULT_TRENDING_THRESHOLD = 5
DEFAULT_BOT_WINDOW_MINUTES = 5
DEFAULT_BOT_RATIO_THRESHOLD = 0.8
DEFAULT_BOT_MIN_VOLUME = 10
RECENT_SIGNALS = 50
TRENDING = "TRENDING"
BOT_ANOMALY = "BOT_ANOMALY"
GLOBAL_KEY = "global"


def window_duration(width: int | str) -> str:
    """Minutes (int, as the reference configures it) or a Spark duration string."""
    if isinstance(width, bool):
        raise ValueError("window width must be minutes or a duration string")
    if isinstance(width, int):
        if width <= 0:
            raise ValueError(f"window width must be > 0, got {width}")
        return f"{width} minutes"
    if not isinstance(width, str) or not width.strip():
        raise ValueError(f"bad window width {width!r}")
    return width


_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
          "day": 86_400_000_000, "week": 604_800_000_000}


def window_micros(width: int | str) -> int:
    """Length of a window in microseconds; widths have fixed lengths, so no months or years."""
    text = window_duration(width).lower().removeprefix("interval ").strip()
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?(?=\s|\d|$)", text)
    if not parts or re.sub(r"(\d+)\s*([a-z]+?)s?(?=\s|\d|$)", "", text).strip() or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"bad window width {width!r}: numbers of weeks, days, hours, minutes, seconds or parts of these")
    total = sum(int(n) * _UNITS[u] for n, u in parts)
    if total <= 0:
        raise ValueError(f"window width must be > 0, got {width!r}")
    return total


@dataclass(frozen=True)
class TrendingParams:
    window: int | str = DEFAULT_TRENDING_WINDOW_MINUTES
    threshold: int = DEFAULT_TRENDING_THRESHOLD

    def __post_init__(self):
        window_duration(self.window)
        if self.threshold is None:
            raise ValueError("trending threshold must be set")


@dataclass(frozen=True)
class BotParams:
    window: int | str = DEFAULT_BOT_WINDOW_MINUTES
    ratio_threshold: float = DEFAULT_BOT_RATIO_THRESHOLD
    min_volume: int = DEFAULT_BOT_MIN_VOLUME

    def __post_init__(self):
        window_duration(self.window)
        if self.ratio_threshold is None or self.min_volume is None:
            raise ValueError("bot ratio threshold and minimum volume must be set")


@dataclass(frozen=True)
class Arrival:
    """How records are ordered on arrival (the reference's partition/offset order).

    ``order`` - columns giving the arrival order (unique together).
    ``partitions`` - columns that scope stream time (an input partition); empty = one global clock.
    ``bucket`` - a numeric column, non-decreasing along ``order`` within a partition, used to
    split one hot group into ordered sub-ranges so no single task holds it.
    ``digits`` - optional decimal digits per ``order`` column for packing the order into one
    exact ``decimal(38,0)`` key (see ``operators/arrival.py``); default by column type.
    ``split`` - order columns that an order too wide to pack is reduced by first.
    ``emitted`` - columns of a signal's ``emitted`` struct; default ``order``.
    """

    order: tuple[str, ...] = ("arrival_ts", "arrival_id")
    partitions: tuple[str, ...] = ()
    bucket: str = "arrival_bucket"
    digits: tuple[int, ...] | None = None
    split: tuple[str, ...] = ()
    emitted: tuple[str, ...] = ()

    @property
    def emitted_columns(self) -> tuple[str, ...]:
        return self.emitted or self.order
