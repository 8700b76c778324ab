"""Driver queries: each takes (spark, sf_dir) and returns a DataFrame over the whole
``events`` table (or data Spark derives from it). Paired one-to-one with
:func:`.oracles.oracle_sql`; column names and types match it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import codec, display
from ..params import Arrival, BotParams, TrendingParams
from ..session import prepare, scratch_path
from ..sources import events_table as ET
from ..sources.records import read_event_records, read_signal_records
from ..sources.sse import sse_payloads
from .oracles import B_R, B_V, B_W, B_W_DAY, T_N, T_W

TRENDING_DAY = TrendingParams(window=T_W, threshold=T_N)
BOT_HOUR = BotParams(window=B_W, ratio_threshold=B_R, min_volume=B_V)
BOT_DAY = BotParams(window=B_W_DAY, ratio_threshold=B_R, min_volume=B_V)
ARRIVAL = Arrival()

EVENT_OUT = ["title", "wiki", "`user`", "bot", "`timestamp`", "`type`", "`comment`", "namespace",
             "revision.old AS revision_old", "revision.new AS revision_new",
             "length.old AS length_old", "length.new AS length_new"]
SIGNAL_OUT = ["signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "ratio",
              "window_start", "window_end"]


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps returned to the oracle as NTZ (UTC wall clock), the type DuckDB reads."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ET.read_table(prepare(spark), sf_dir, "events")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ET.edits(_events(spark, sf_dir))


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.main_namespace(_edits(spark, sf_dir))


def _decoded_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decode_events(sse_payloads(ET.sse_lines(_events(spark, sf_dir))))


def _flat_signals(df: DataFrame) -> DataFrame:
    return ntz(df.select(*SIGNAL_OUT), "window_start", "window_end")


def _flat_emitted(df: DataFrame) -> DataFrame:
    out = df.select(*SIGNAL_OUT, F.col("emitted.arrival_ts").alias("emitted_ts"),
                    F.col("emitted.arrival_id").alias("emitted_id"))
    return ntz(out, "window_start", "window_end", "emitted_ts")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.detect_signals(_main(spark, sf_dir), TRENDING_DAY, BOT_HOUR, arrival=ARRIVAL)


# ---- ingest ---------------------------------------------------------------

def q_sse_decode(spark, sf_dir):
    good, _ = codec.split_malformed(_decoded_feed(spark, sf_dir))
    return good.selectExpr("event_id", *EVENT_OUT)


def q_sse_quarantine(spark, sf_dir):
    _, bad = codec.split_malformed(_decoded_feed(spark, sf_dir))
    return bad.select("event_id", "payload")


def q_main_namespace(spark, sf_dir):
    return _main(spark, sf_dir).selectExpr("event_id", *EVENT_OUT)


def q_keyed_edits(spark, sf_dir):
    return O.key_by_title(_main(spark, sf_dir)).select("key", "event_id", "wiki", "title")


def q_event_round_trip(spark, sf_dir):
    encoded = codec.encode_events(_edits(spark, sf_dir)).select("event_id", "value")
    return codec.decode_events(encoded, payload="value", mode="strict").selectExpr("event_id", *EVENT_OUT)


def q_ingest_counts(spark, sf_dir):
    return O.ingest_counts(_decoded_feed(spark, sf_dir))


# ---- windows and signals ----------------------------------------------------

def q_tumbling_edit_counts(spark, sf_dir):
    return ntz(O.tumbling_edit_counts(_main(spark, sf_dir), T_W), "window_start", "window_end")


def q_tumbling_edit_counts_by_wiki(spark, sf_dir):
    return ntz(O.tumbling_edit_counts(_main(spark, sf_dir), T_W, keys=("wiki", "title")),
               "window_start", "window_end")


def q_tumbling_bot_counts(spark, sf_dir):
    return ntz(O.tumbling_bot_counts(_main(spark, sf_dir), B_W), "window_start", "window_end")


def q_trending_signals(spark, sf_dir):
    return _flat_signals(O.trending_signals(_main(spark, sf_dir), TRENDING_DAY))


def q_bot_anomaly_signals(spark, sf_dir):
    return _flat_signals(O.bot_anomaly_signals(_main(spark, sf_dir), BOT_HOUR))


def q_bot_anomaly_signals_daily(spark, sf_dir):
    return _flat_signals(O.bot_anomaly_signals(_main(spark, sf_dir), BOT_DAY))


def q_detect_signals(spark, sf_dir):
    main = _main(spark, sf_dir)
    return _flat_signals(O.detect_signals(main, TRENDING_DAY, BOT_HOUR))


# ---- lateness and revisions ------------------------------------------------

def q_late_rows(spark, sf_dir):
    late = O.late_rows(_main(spark, sf_dir), B_W, ARRIVAL)
    late = O.tumbling(late, B_W).select("event_id", "title", "event_time", "arrival_ts", "window_start")
    return ntz(late, "event_time", "arrival_ts", "window_start")


def q_trending_no_grace(spark, sf_dir):
    return _flat_signals(O.trending_signals(_main(spark, sf_dir), TRENDING_DAY, arrival=ARRIVAL, late="drop"))


def q_bot_no_grace(spark, sf_dir):
    return _flat_signals(O.bot_anomaly_signals(_main(spark, sf_dir), BOT_HOUR, arrival=ARRIVAL, late="drop"))


def q_trending_revisions(spark, sf_dir):
    return _flat_emitted(O.trending_revisions(_main(spark, sf_dir), TRENDING_DAY, ARRIVAL))


def q_bot_revisions(spark, sf_dir):
    return _flat_emitted(O.bot_revisions(_main(spark, sf_dir), BOT_HOUR, ARRIVAL))


def q_first_crossing(spark, sf_dir):
    main = _main(spark, sf_dir)
    return _flat_emitted(O.first_crossing(O.signal_revisions(main, TRENDING_DAY, BOT_HOUR, ARRIVAL, first=True)))


def q_partitioned_no_grace(spark, sf_dir):
    """A topic keyed by title over 7 partitions, read with the default arrival orders: a clock per
    partition for trending, the merge of the partitions for bots. Offsets follow arrival, so records
    are out of time order inside their partition; every 13th record of the topic has no value."""
    from .jobs import detect_from_records
    main = _main(spark, sf_dir).filter("title is not null")
    recs = codec.encode_events(O.key_by_title(main)).select(
        "key", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"), F.col("event_time").alias("timestamp"),
        F.pmod(F.substring("title", 6, 20).cast("bigint"), F.lit(7)).cast("int").alias("partition"),
        (F.unix_seconds("arrival_ts") * 1_000_000_000 + F.col("event_id")).alias("offset"))
    path = scratch_path(spark, "topic")
    recs.write.parquet(path)
    out = detect_from_records(spark, path, TRENDING_DAY, BOT_HOUR)
    return ntz(out.select(*SIGNAL_OUT, F.col("emitted.record_ts").alias("emitted_ts")), "window_start", "window_end", "emitted_ts")


# ---- wire form, store, report -------------------------------------------------

def q_signal_round_trip(spark, sf_dir):
    wire = codec.encode_signals(O.detect_signals(_main(spark, sf_dir), TRENDING_DAY, BOT_HOUR)).select("value")
    return _flat_signals(codec.decode_signals(wire))


def q_signal_store(spark, sf_dir):
    return O.upsert_signals(_detected(spark, sf_dir), order=("emitted",), key="window")


def q_signal_store_by_title(spark, sf_dir):
    return O.upsert_signals(_detected(spark, sf_dir), order=("emitted",), key="window_title")


def q_recent_signals(spark, sf_dir):
    return _flat_emitted(O.recent_signals(_detected(spark, sf_dir)))


def q_signal_display(spark, sf_dir):
    out = display.signal_display(_detected(spark, sf_dir))
    return ntz(out.select("signal_type", "title", "window_start", "display_type", "display_title",
                          "display_metrics", "display_window"), "window_start")


def q_signal_html(spark, sf_dir):
    out = display.signal_html_rows(_detected(spark, sf_dir))
    return ntz(out.select("signal_type", "title", "window_start", "html_row"), "window_start")


def q_signals_json(spark, sf_dir):
    return O.signals_json(_detected(spark, sf_dir))


# ---- streaming: replay the table as ordered files, run availableNow, read the sink ----

RECORD_COLUMNS = ("key", "value", "timestamp", "partition", "offset")


def _ordered_edits(spark, sf_dir) -> DataFrame:
    """Main-namespace edits in event order (``offset``), with their arrival."""
    return _main(spark, sf_dir).withColumns({"offset": F.col("event_id"), "arrival_us": F.unix_micros("arrival_ts")})


def _event_records(edits: DataFrame) -> DataFrame:
    """Edits as event records, record time = event time."""
    return codec.encode_events(O.key_by_title(edits)).select(
        "key", "value", F.col("event_time").alias("timestamp"), F.lit(0).alias("partition"), "offset")


def _stream_signals(spark, sf_dir, trending, bot, output_mode="append", order="offset", **kwargs) -> DataFrame:
    """Decoded signals of a detection stream over the replayed records, one micro-batch a range."""
    from ..streaming.detect import run_detection
    from .replay import land_in_order
    src, out, chk = (scratch_path(spark, n) for n in ("records", "signals", "chk-detect"))
    land_in_order(_ordered_edits(spark, sf_dir), order, src, lambda: run_detection(
        spark, src, out, chk, trending=trending, bot=bot, output_mode=output_mode),
        columns=RECORD_COLUMNS, encode=_event_records, **kwargs)
    return _read_signals(spark, out)


def _read_signals(spark, path) -> DataFrame:
    return codec.decode_signals(read_signal_records(spark, path))


def q_stream_trending(spark, sf_dir):
    return _flat_signals(_stream_signals(spark, sf_dir, TRENDING_DAY, None))


def q_stream_bot(spark, sf_dir):
    return _flat_signals(_stream_signals(spark, sf_dir, None, BOT_HOUR))


def q_stream_detect(spark, sf_dir):
    return _flat_signals(_stream_signals(spark, sf_dir, TRENDING_DAY, BOT_HOUR))


def q_stream_trending_updates(spark, sf_dir):
    """update mode: one row per micro-batch for each window it changed that passes."""
    return _flat_signals(_stream_signals(spark, sf_dir, TRENDING_DAY, None, output_mode="update"))


def q_stream_resume(spark, sf_dir):
    """Half of the records, a stop, the other half, a restart on the same checkpoint."""
    return _flat_signals(_stream_signals(spark, sf_dir, TRENDING_DAY, BOT_HOUR, ranges=2))


def q_stream_late(spark, sf_dir):
    """Records in arrival order, so late ones cross micro-batches and are dropped by the watermark."""
    return _flat_signals(_stream_signals(spark, sf_dir, TRENDING_DAY, BOT_HOUR, order="arrival_us"))


def _exact_stream(spark, sf_dir, emit):
    """Exact detection over the records in arrival order, as one ordered log in five micro-batches with a restart after
    each; (signals, state)."""
    from ..streaming.exact import run_exact_detection
    from .replay import land_in_order
    src, out, state, chk = (scratch_path(spark, n) for n in ("records", "signals", "state", "chk-exact"))
    log = _ordered_edits(spark, sf_dir).withColumn(
        "offset", F.floor(F.col("arrival_us") / 1_000_000) * 1_000_000_000 + F.col("offset"))
    land_in_order(log, "offset", src, lambda: run_exact_detection(
        spark, src, out, state, chk, TRENDING_DAY, BOT_HOUR, emit=emit, offsets_per_bucket=60_000_000_000),
        columns=RECORD_COLUMNS, encode=_event_records, ranges=5)
    return out, state


def q_stream_exact_revisions(spark, sf_dir):
    """Every update of both detectors, lateness judged per record across the micro-batches."""
    out = _read_signals(spark, _exact_stream(spark, sf_dir, "updates")[0])
    out = out.select(*SIGNAL_OUT, F.col("record_ts").alias("emitted_ts"), F.col("offset").alias("emitted_id"))
    return ntz(out, "window_start", "window_end", "emitted_ts")


def q_stream_exact_signals(spark, sf_dir):
    """Final signals: those of closed windows from the sink, those of open ones from the state."""
    from ..streaming.exact import open_signals
    out, state = _exact_stream(spark, sf_dir, "final")
    still_open = open_signals(spark, state, TRENDING_DAY, BOT_HOUR)
    return _flat_signals(_read_signals(spark, out).select(*SIGNAL_OUT).unionByName(still_open.select(*SIGNAL_OUT)))


def _land_feed(spark, sf_dir, path, run):
    from .replay import land_in_order
    land_in_order(_events(spark, sf_dir), "event_id", path, run, fmt="text",
                  sort_cols=("event_id", "line_no"), columns=("value",), encode=ET.sse_frames)


def _stream_ingest(spark, sf_dir):
    from ..streaming.ingest import run_ingest
    feed, recs, bad, chk = (scratch_path(spark, n) for n in ("feed", "event-records", "quarantine", "chk-ingest"))
    _land_feed(spark, sf_dir, feed, lambda: run_ingest(spark, feed, recs, bad, chk))
    return recs


def q_stream_feed_to_signals(spark, sf_dir):
    """Feed files -> streaming ingest (landing decoded edits) -> streaming detection
    reading those edits (no JSON parsing in detection) -> signal records."""
    from ..streaming.detect import run_detection
    from ..streaming.ingest import run_ingest
    feed, recs, bad, edits, out, chk, chk2 = (scratch_path(spark, n) for n in (
        "feed", "records", "bad", "edits", "signals", "chk-ingest", "chk-detect"))

    def run():
        run_ingest(spark, feed, recs, bad, chk, edits_path=edits)
        run_detection(spark, edits, out, chk2, trending=TRENDING_DAY, bot=BOT_HOUR, source_format="edits")

    _land_feed(spark, sf_dir, feed, run)
    return _flat_signals(_read_signals(spark, out))


def q_stream_ingest_counts(spark, sf_dir):
    """Counters the streaming ingest landed, summed over its micro-batches."""
    return O.landed_counts(spark, _stream_ingest(spark, sf_dir))


def q_stream_ingest(spark, sf_dir):
    landed = codec.decode_events(read_event_records(spark, _stream_ingest(spark, sf_dir)), payload="value", mode="strict")
    return landed.selectExpr("key", *EVENT_OUT, "CAST(unix_seconds(record_ts) AS BIGINT) AS record_seconds")


def q_stream_landed_topic(spark, sf_dir):
    """A consumer of a topic that is compacted while it reads: it takes what is new after every range of the feed, from
    the list of live folders, and sees every record once."""
    from .. import schemas as S
    from ..streaming.common import write_batch_partition
    from ..streaming.ingest import run_ingest
    from ..streaming.landed import consume_landed
    feed, recs, bad, chk, position, out = (scratch_path(spark, n) for n in (
        "feed", "event-records", "quarantine", "chk-ingest", "position", "consumed"))
    turns = []

    def run():
        run_ingest(spark, feed, recs, bad, chk, compact_every=2)
        turns.append(len(turns))
        if turns[-1] != 1:  # after the second range the consumer is away; its batches are compacted meanwhile
            consume_landed(spark, recs, S.EVENT_RECORD, position,
                           lambda rows, last: write_batch_partition(rows.drop("batch_id"), last, out))

    _land_feed(spark, sf_dir, feed, run)
    landed = codec.decode_events(read_event_records(spark, out), payload="value", mode="strict")
    return landed.selectExpr("key", *EVENT_OUT, "CAST(unix_seconds(record_ts) AS BIGINT) AS record_seconds")


def _serve_stream(spark, sf_dir, trending, bot, output_mode):
    """Records -> detection -> serving, a micro-batch of each per range; (store log, recent snapshots)."""
    from ..streaming.detect import run_detection
    from ..streaming.serve import run_serving
    from .replay import land_in_order
    src, sig, log, recent, chk, chk2 = (scratch_path(spark, n) for n in (
        "records", "signals", "store-log", "recent", "chk-detect", "chk-serve"))

    def run():
        run_detection(spark, src, sig, chk, trending=trending, bot=bot, output_mode=output_mode)
        run_serving(spark, sig, log, recent, chk2)

    land_in_order(_ordered_edits(spark, sf_dir), "offset", src, run, columns=RECORD_COLUMNS, encode=_event_records)
    return log, recent


def q_stream_store(spark, sf_dir):
    """Every update of both detectors reaches the store, open windows too; nothing is overwritten but its own window."""
    from ..streaming.serve import store_view
    log, _ = _serve_stream(spark, sf_dir, TRENDING_DAY, BOT_HOUR, "update")
    return store_view(spark, log, key="window_title")


def q_stream_store_window(spark, sf_dir):
    """The same store by (type, window end): titles of one window overwrite each other."""
    from ..streaming.serve import store_view
    log, _ = _serve_stream(spark, sf_dir, TRENDING_DAY, BOT_HOUR, "update")
    return store_view(spark, log)


def q_stream_recent(spark, sf_dir):
    """The newest 50 of all updates of both detectors, from the serving job's snapshot."""
    from ..streaming.serve import recent_view
    _, recent = _serve_stream(spark, sf_dir, TRENDING_DAY, BOT_HOUR, "update")
    out = recent_view(spark, recent).select(*SIGNAL_OUT, F.col("emitted.record_ts").alias("emitted_ts"),
                                            F.col("emitted.offset").alias("emitted_id"))
    return ntz(out, "window_start", "window_end", "emitted_ts")


def q_stream_open_windows(spark, sf_dir):
    """Signals an append-mode detection has not emitted: its windows still open, from the state of its checkpoint."""
    from ..streaming.detect import open_windows, run_detection
    from .replay import land_in_order
    src, out, chk = (scratch_path(spark, n) for n in ("records", "signals", "chk-detect"))
    land_in_order(_ordered_edits(spark, sf_dir), "offset", src, lambda: run_detection(
        spark, src, out, chk, trending=TRENDING_DAY, bot=BOT_HOUR), columns=RECORD_COLUMNS, encode=_event_records)
    return _flat_signals(open_windows(spark, chk, TRENDING_DAY, BOT_HOUR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
