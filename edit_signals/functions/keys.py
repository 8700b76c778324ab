"""Store keys of a signal: partition key = type, sort key = window end in epoch millis (text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal_keys(signals: DataFrame) -> DataFrame:
    return signals.withColumns({
        "pk": F.col("signal_type"),
        "sk": F.unix_millis(F.col("window_end")).cast("string"),
    })
