"""Display columns of the recent-signals report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BOT_ANOMALY, TRENDING

# Fixed display formats (must equal the reference's dashboard output).
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"          # UTC
TRENDING_METRICS = "%d edits"
BOT_METRICS = "%d/%d (%d%%)"
WINDOW_TEXT = "%s - %s"
NO_TITLE = "-"
HTML_ROW = "<tr><td>%s</td><td>%s</td><td>%s</td><td>%s</td></tr>"


def ratio_percent(ratio: Column) -> Column:
    """Round half up to a whole percent (as ``(int) Math.round(ratio * 100)``)."""
    return F.floor(ratio * F.lit(100) + F.lit(0.5)).cast("int")


def _window_text() -> Column:
    return F.format_string(WINDOW_TEXT, F.date_format("window_start", TIME_FORMAT),
                           F.date_format("window_end", TIME_FORMAT))


def _metrics() -> Column:
    return (F.when(F.col("signal_type") == TRENDING, F.format_string(TRENDING_METRICS, F.col("edit_count")))
            .when(F.col("signal_type") == BOT_ANOMALY,
                  F.format_string(BOT_METRICS, F.col("bot_edit_count"), F.col("total_edit_count"),
                                  ratio_percent(F.col("ratio")))))


def _title_text() -> Column:
    return F.when(F.col("signal_type") == TRENDING, F.coalesce(F.col("title"), F.lit("null"))).otherwise(F.lit(NO_TITLE))


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def signal_display(signals: DataFrame) -> DataFrame:
    """Adds ``display_type``, ``display_title``, ``display_metrics``, ``display_window``."""
    return signals.withColumns({
        "display_type": F.col("signal_type"),
        "display_title": _title_text(),
        "display_metrics": _metrics(),
        "display_window": _window_text(),
    })


def signal_html_rows(signals: DataFrame, escape: bool = True) -> DataFrame:
    """Adds ``html_row``: one table row per signal. Titles are HTML-escaped unless ``escape=False``."""
    title = _title_text()
    if escape:
        title = html_escape(title)
    return signals.withColumn("html_row", F.format_string(HTML_ROW, F.col("signal_type"), title, _metrics(),
                                                          _window_text()))
