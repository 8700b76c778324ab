"""Signal JSON, store keys / upsert, recent report and display."""

import datetime as dt
import json

from pyspark.sql import functions as F

from edit_signals.functions import (decode_signals, encode_signals, ratio_percent, signal_display,
                                    signal_html_rows, signal_keys)
from edit_signals.operators import recent_signals, signals_json, upsert_signals

SIG_DDL = ("signal_type string, title string, edit_count int, bot_edit_count int, total_edit_count int, "
           "ratio double, window_start timestamp, window_end timestamp, key string, emitted bigint")


def ts(ms):
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


def sig(spark, rows):
    return spark.createDataFrame(rows, SIG_DDL)


def _trend(title, n, ws, we, emitted=0):
    return ("TRENDING", title, n, None, None, None, ts(ws), ts(we), title, emitted)


def _bot(b, t, r, ws, we, emitted=0):
    return ("BOT_ANOMALY", None, None, b, t, r, ts(ws), ts(we), "global", emitted)


def test_encode_forms(spark):
    df = sig(spark, [_trend("Salt_\"marsh\"", 12, 1936000000000, 1936000900000),
                     _bot(31, 32, 0.96875, 1935999100000, 1936000000000)])
    out = {r.signal_type: r.value for r in encode_signals(df).collect()}
    assert out["TRENDING"] == ('{"signalType":"TRENDING","title":"Salt_\\"marsh\\"","editCount":12,'
                               '"windowStart":1936000000000,"windowEnd":1936000900000}')
    assert out["BOT_ANOMALY"] == ('{"signalType":"BOT_ANOMALY","botEditCount":31,"totalEditCount":32,'
                                  '"ratio":0.96875,"windowStart":1935999100000,"windowEnd":1936000000000}')


def test_counts_beyond_the_wire_field_fail(spark):
    import pytest
    df = sig(spark, [_trend("A", 5, 0, 300000)]).withColumn("edit_count", F.lit(2 ** 31).cast("bigint"))
    with pytest.raises(Exception, match="32-bit"):
        encode_signals(df).collect()


def test_decode_round_trip_and_rejects(spark):
    df = sig(spark, [_trend("A", 7, 1000, 301000), _bot(9, 10, 0.9, 0, 300000)])
    wire = encode_signals(df).select("value")
    extra = spark.createDataFrame([
        ('{"signalType":"UNKNOWN","windowStart":1,"windowEnd":2}',),
        ('{"title":"A","editCount":1,"windowStart":1,"windowEnd":2}',),          # no type
        ('{"signalType":"TRENDING","title":"A","editCount":1,"windowStart":1,"windowEnd":2,"x":1}',),
        ('{"signalType":"TRENDING","title":"A","editCount":1,"ratio":0.5,"windowStart":1,"windowEnd":2}',),
        ('{broken',),
        ('{"signalType":"TRENDING","title":"Z","windowStart":1,"windowEnd":2}',),   # absent count -> 0
    ], "value string")
    back = decode_signals(wire.unionByName(extra)).select(
        "signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "ratio", "window_start",
        "window_end").collect()
    got = sorted(back, key=lambda r: (r.signal_type, r.title or ""))
    assert [tuple(r) for r in got] == [
        ("BOT_ANOMALY", None, None, 9, 10, 0.9, ts(0), ts(300000)),
        ("TRENDING", "A", 7, None, None, None, ts(1000), ts(301000)),
        ("TRENDING", "Z", 0, None, None, None, ts(1), ts(2)),
    ]


def test_store_keys(spark):
    df = signal_keys(sig(spark, [_trend("A", 5, 1936000000000, 1936000900000)]))
    r = df.first()
    assert (r.pk, r.sk) == ("TRENDING", "1936000900000")


def test_upsert_last_write_wins(spark):
    df = sig(spark, [_trend("A", 5, 0, 300000, emitted=1), _trend("B", 6, 0, 300000, emitted=2),
                     _trend("A", 7, 300000, 600000, emitted=3), _bot(9, 10, 0.9, 0, 300000, emitted=4)])
    out = {(r.pk, r.sk): (r.title, r.editCount, r.botEditCount) for r in upsert_signals(df).collect()}
    assert out == {("TRENDING", "300000"): ("B", 6, None), ("TRENDING", "600000"): ("A", 7, None),
                   ("BOT_ANOMALY", "300000"): (None, None, 9)}
    by_title = upsert_signals(df, key="window_title").count()
    assert by_title == 4


def test_recent_keeps_newest_fifty(spark):
    order = [(i * 37) % 71 for i in range(71)]  # a permutation: arrival is not the order of the rows
    df = sig(spark, [_trend(f"t{e}", 5 + e, 60_000 * e, 60_000 * e + 300_000, emitted=e) for e in order])
    assert [x.title for x in recent_signals(df).collect()] == [f"t{e}" for e in range(70, 20, -1)]
    assert len(json.loads(signals_json(df).first().signals_json)) == 50


def test_signals_json_order_and_empty(spark):
    df = sig(spark, [_trend("A", 5, 0, 300000, emitted=1), _bot(9, 10, 0.9, 0, 300000, emitted=2)])
    js = json.loads(signals_json(recent_signals(df)).first().signals_json)
    assert [s["signalType"] for s in js] == ["BOT_ANOMALY", "TRENDING"]
    assert signals_json(recent_signals(df.limit(0))).first().signals_json == "[]"


def test_display_and_html(spark):
    df = sig(spark, [_bot(47, 50, 0.94, 1936000000000, 1936000900000),
                     _trend("<b>&", 12, 1936000000000, 1936000900000)])
    rows = {r.signal_type: r for r in signal_html_rows(signal_display(df)).collect()}
    b, t = rows["BOT_ANOMALY"], rows["TRENDING"]
    assert (b.display_title, b.display_metrics) == ("-", "47/50 (94%)")
    assert b.display_window == "2031-05-08 09:46:40 - 2031-05-08 10:01:40"
    assert t.display_metrics == "12 edits"
    assert t.html_row == ("<tr><td>TRENDING</td><td>&lt;b&gt;&amp;</td><td>12 edits</td>"
                          "<td>2031-05-08 09:46:40 - 2031-05-08 10:01:40</td></tr>")
    raw = signal_html_rows(df, escape=False).filter("signal_type = 'TRENDING'").first().html_row
    assert "<td><b>&</td>" in raw


def test_ratio_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(0.125,), (0.835,), (0.8333333333333334,), (0.005,)], "r double")
    got = [r.p for r in df.select(ratio_percent(F.col("r")).alias("p")).collect()]
    assert got == [13, 84, 83, 1]
