"""JSON edges: decode / encode edit events and signals (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..params import BOT_ANOMALY, TRENDING

_PARSE_EVENT = T.StructType(S.EVENT.fields + [T.StructField(S.CORRUPT, T.StringType())])
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT, "allowSingleQuotes": "false"}
_FAILFAST = {"mode": "FAILFAST", "allowSingleQuotes": "false"}


def parse_once(expr: Column) -> Column:
    """Evaluate an expensive parse exactly once per row.

    Catalyst pushes a filter through the projection that computed a column and inlines
    the expression into the condition, so ``from_json`` would run again for every
    predicate on its fields. A one-element ``explode`` is a Generate node, which filters
    on its output cannot cross: the parse stays single. Use as
    ``df.select("*", parse_once(e).alias(name))``; a NULL result still yields one row.
    """
    return F.explode(F.array(expr))


def _zero_struct(c: str, fields: list[tuple[str, str]]) -> Column:
    """Struct kept NULL when absent; absent inner primitives become 0."""
    inner = F.struct(*[F.coalesce(F.col(c)[f], F.lit(0).cast(t)).alias(f) for f, t in fields])
    return F.when(F.col(c).isNull(), F.lit(None)).otherwise(inner)


def with_event_defaults(df: DataFrame) -> DataFrame:
    """Primitive defaults of the feed decoder: absent bot -> false, timestamp/namespace -> 0."""
    return df.withColumns({
        "bot": F.coalesce(F.col("bot"), F.lit(False)),
        "timestamp": F.coalesce(F.col("timestamp"), F.lit(0).cast("bigint")),
        "namespace": F.coalesce(F.col("namespace"), F.lit(0)),
        "revision": _zero_struct("revision", [("old", "bigint"), ("new", "bigint")]),
        "length": _zero_struct("length", [("old", "int"), ("new", "int")]),
    })


def decode_events(df: DataFrame, payload: str = "payload", mode: str = "permissive") -> DataFrame:
    """Parse ``payload`` JSON into the event columns (unknown fields ignored).

    ``permissive``: adds ``_malformed`` (bool) - the row could not be decoded; use
    :func:`split_malformed`. ``strict``: a malformed or blank payload fails the job (FAILFAST);
    records without a value (null) are skipped, as the aggregations skip them.
    """
    if mode == "strict":
        df = df.filter(F.col(payload).isNotNull())
        blank = F.raise_error(F.lit("blank event payload")).cast(S.EVENT)
        ev = F.when(F.trim(F.col(payload)) == "", blank).otherwise(F.from_json(F.col(payload), S.EVENT, _FAILFAST))
        out = (df.select("*", parse_once(ev).alias("_ev"))
               .select("*", *[F.col("_ev")[f].alias(f) for f in S.EVENT_FIELDS]).drop("_ev"))
        return with_event_defaults(out)
    if mode != "permissive":
        raise ValueError(f"unknown decode mode {mode!r}")
    ev = F.from_json(F.col(payload), _PARSE_EVENT, _PERMISSIVE)
    out = (
        df.select("*", parse_once(ev).alias("_ev"))
        .select("*",
                *[F.col("_ev")[f].alias(f) for f in S.EVENT_FIELDS],
                (F.col("_ev").isNull() | F.col("_ev")[S.CORRUPT].isNotNull()).alias("_malformed"))
        .drop("_ev")
    )
    return with_event_defaults(out)


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows). Quarantine keeps every input column (raw line, payload)."""
    good = decoded.filter(~F.col("_malformed")).drop("_malformed")
    bad = decoded.filter(F.col("_malformed")).drop(*S.EVENT_FIELDS, "_malformed")
    return good, bad


def event_struct() -> Column:
    return F.struct(*[F.col(f) for f in S.EVENT_FIELDS])


def encode_events(df: DataFrame, out: str = "value") -> DataFrame:
    """Event columns -> JSON (nulls written as null, as the reference's serializer does)."""
    return df.withColumn(out, F.to_json(event_struct(), {"ignoreNullFields": "false"}))


def encode_feed_json(df: DataFrame) -> Column:
    """Feed-style JSON of an event (absent fields omitted, extra metadata fields present)."""
    return F.to_json(F.struct(
        F.lit("/mediawiki/recentchange/1.0.0").alias("$schema"),
        F.struct(F.col("event_id").alias("offset")).alias("meta"),
        F.col("event_id").alias("id"),
        *[F.col(f) for f in S.EVENT_FIELDS],
    ))


# ---- signals ---------------------------------------------------------------

def _wire_count(name: str) -> Column:
    """A count in the 32-bit field of the wire form; a larger one is an error, never a wrong number."""
    too_big = F.raise_error(F.concat(F.lit(f"{name} does not fit the signal's 32-bit field: "), F.col(name).cast("string")))
    return F.when(F.col(name) > F.lit(2 ** 31 - 1), too_big.cast("int")).otherwise(F.col(name).cast("int"))


def signal_wire_struct() -> Column:
    return F.struct(
        F.col("signal_type").alias("signalType"),
        F.col("title").alias("title"),
        _wire_count("edit_count").alias("editCount"),
        _wire_count("bot_edit_count").alias("botEditCount"),
        _wire_count("total_edit_count").alias("totalEditCount"),
        F.col("ratio").alias("ratio"),
        F.unix_millis(F.col("window_start")).alias("windowStart"),
        F.unix_millis(F.col("window_end")).alias("windowEnd"),
    )


def encode_signals(signals: DataFrame, out: str = "value") -> DataFrame:
    """Wide signal rows -> tagged JSON; the other variant's (NULL) fields are omitted.

    Trending titles are never NULL (null keys are dropped before counting), so omitting
    nulls yields exactly the per-variant field list.
    """
    return signals.withColumn(out, F.to_json(signal_wire_struct()))


def decode_signals(df: DataFrame, value: str = "value") -> DataFrame:
    """Tagged JSON -> wide signal rows. A record is dropped when the JSON is malformed,
    the type tag is missing or unknown, or a key is not a field of its variant.
    Absent numeric fields of the variant decode as 0."""
    parse = T.StructType(S.SIGNAL_WIRE.fields + [T.StructField(S.CORRUPT, T.StringType())])
    sig = F.from_json(F.col(value), parse, _PERMISSIVE)
    keys = F.json_object_keys(F.col(value))
    t = F.col("_sig.signalType")
    allowed = (F.when(t == TRENDING, F.array(*[F.lit(x) for x in S.SIGNAL_KEYS[TRENDING]]))
               .when(t == BOT_ANOMALY, F.array(*[F.lit(x) for x in S.SIGNAL_KEYS[BOT_ANOMALY]])))
    ok = (F.col("_sig").isNotNull() & F.col(f"_sig.{S.CORRUPT}").isNull() & t.isin(TRENDING, BOT_ANOMALY)
          & keys.isNotNull() & (F.size(F.array_except(keys, allowed)) == 0))
    zero_l, zero_d = F.lit(0).cast("bigint"), F.lit(0.0)
    is_tr, is_bot = t == TRENDING, t == BOT_ANOMALY
    return (
        df.select("*", parse_once(sig).alias("_sig"))
        .filter(ok)
        .select(
            "*",
            t.alias("signal_type"),
            F.when(is_tr, F.col("_sig.title")).alias("title"),
            F.when(is_tr, F.coalesce(F.col("_sig.editCount"), zero_l)).alias("edit_count"),
            F.when(is_bot, F.coalesce(F.col("_sig.botEditCount"), zero_l)).alias("bot_edit_count"),
            F.when(is_bot, F.coalesce(F.col("_sig.totalEditCount"), zero_l)).alias("total_edit_count"),
            F.when(is_bot, F.coalesce(F.col("_sig.ratio"), zero_d)).alias("ratio"),
            F.timestamp_millis(F.coalesce(F.col("_sig.windowStart"), zero_l)).alias("window_start"),
            F.timestamp_millis(F.coalesce(F.col("_sig.windowEnd"), zero_l)).alias("window_end"),
        )
        .drop("_sig")
    )
