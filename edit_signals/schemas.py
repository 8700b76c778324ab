"""Fixed schemas: the edit event, the keyed record, and the two-variant signal."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

REVISION = T.StructType([
    T.StructField("old", T.LongType()),
    T.StructField("new", T.LongType()),
])

LENGTH = T.StructType([
    T.StructField("old", T.IntegerType()),
    T.StructField("new", T.IntegerType()),
])

# Edit event as carried in the feed JSON. Unknown JSON fields are ignored.
EVENT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("wiki", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("bot", T.BooleanType()),
    T.StructField("timestamp", T.LongType()),  # epoch seconds
    T.StructField("type", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("namespace", T.IntegerType()),
    T.StructField("revision", REVISION),
    T.StructField("length", LENGTH),
])

EVENT_FIELDS = [f.name for f in EVENT.fields]

# Keyed record of the events topic / landed event table.
EVENT_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# Landed, already decoded edits: event fields plus the record's key / time / position.
# Detection over this table reads only the columns it needs and parses no JSON.
EDIT_TABLE = T.StructType(EVENT.fields + [
    T.StructField("key", T.StringType()),
    T.StructField("record_ts", T.TimestampType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# Signal, wire form: camelCase names, window bounds in epoch millis.
SIGNAL_WIRE = T.StructType([
    T.StructField("signalType", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("editCount", T.IntegerType()),
    T.StructField("botEditCount", T.IntegerType()),
    T.StructField("totalEditCount", T.IntegerType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("windowStart", T.LongType()),
    T.StructField("windowEnd", T.LongType()),
])

# Keys each variant may carry on the wire (anything else makes the record undecodable).
SIGNAL_KEYS = {
    "TRENDING": ["signalType", "title", "editCount", "windowStart", "windowEnd"],
    "BOT_ANOMALY": ["signalType", "botEditCount", "totalEditCount", "ratio", "windowStart", "windowEnd"],
}
