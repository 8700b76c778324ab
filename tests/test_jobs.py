"""The three stages as batch jobs, and the observed counters of the streaming ingest."""

import json

from edit_signals.params import BotParams, TrendingParams
from edit_signals.plans.jobs import detect_from_records, ingest_feed, publish_signals, serve_signals
from edit_signals.session import scratch_path
from edit_signals.sources.records import FILE_ARRIVAL
from edit_signals.streaming.ingest import run_ingest
from edit_signals.operators.counters import landed_counts

T0 = 1704067200  # 2024-01-01T00:00:00Z


def _line(title, ts, ns=0, bot=False, space=True):
    ev = json.dumps({"title": title, "wiki": "enwiki", "user": "u", "bot": bot, "timestamp": ts,
                     "type": "edit", "namespace": ns, "revision": {"old": 1, "new": 2}})
    return ("data: " if space else "data:") + ev


def _feed(spark, lines):
    path = scratch_path(spark, "feed")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_batch_stages(spark):
    lines = [": hello", "event: message"]
    lines += [_line("Hot", T0 + i * 20, bot=True, space=i % 2 == 0) for i in range(6)]
    lines += [_line(f"B{i}", T0 + 130 + i, bot=True) for i in range(5)]
    lines += [_line("Talk:Hot", T0 + 5, ns=1), "data: {broken", ""]
    feed = _feed(spark, lines)
    recs, bad = scratch_path(spark, "recs"), scratch_path(spark, "bad")
    edits = scratch_path(spark, "edits")
    counts = ingest_feed(spark, feed, recs, bad, edits_path=edits)
    assert counts == {"published": 11, "filtered": 1, "failed": 1}
    assert spark.read.parquet(bad).count() == 1

    want = [("BOT_ANOMALY", None, None, 11, 11), ("TRENDING", "Hot", 6, None, None)]
    for src, fmt in [(recs, "parquet"), (edits, "edits")]:
        sig = detect_from_records(spark, src, TrendingParams(), BotParams(), late="drop", arrival=FILE_ARRIVAL,
                                  source_format=fmt)
        got = sorted((r.signal_type, r.title, r.edit_count, r.bot_edit_count, r.total_edit_count)
                     for r in sig.collect())
        assert got == want
    sig = detect_from_records(spark, recs, TrendingParams(), BotParams(), late="drop", arrival=FILE_ARRIVAL)

    revs = detect_from_records(spark, recs, TrendingParams(), BotParams(), revisions=True, arrival=FILE_ARRIVAL)
    assert sorted(r.edit_count for r in revs.filter("signal_type = 'TRENDING'").collect()) == [5, 6]

    out = scratch_path(spark, "signals")
    publish_signals(sig.drop("emitted"), out)
    served = serve_signals(spark, out, scratch_path(spark, "store"))
    assert served["store"].count() == 2
    assert len(json.loads(served["json"].first().signals_json)) == 2
    assert served["html"].count() == 2


def test_stream_ingest_counters(spark):
    feed = _feed(spark, [_line("A", T0), _line("B", T0 + 1, ns=2), "data: nope", ": c"])
    recs = scratch_path(spark, "recs")
    run_ingest(spark, feed, recs, scratch_path(spark, "bad"), scratch_path(spark, "chk"), timeout_s=300)
    assert tuple(landed_counts(spark, recs).first()) == (1, 1, 1)


def test_counters_of_more_batches_than_spark_keeps_reports_of(spark):
    from edit_signals.functions.codec import decode_events
    from edit_signals.sources.sse import sse_payloads
    from edit_signals.streaming.ingest import write_decoded
    recs, bad = scratch_path(spark, "recs"), scratch_path(spark, "bad")
    one = spark.createDataFrame([(_line("A", T0),), ("data: nope",)], "value string").coalesce(1)
    for batch in range(130):
        write_decoded(decode_events(sse_payloads(one)), batch, recs, bad)
    write_decoded(decode_events(sse_payloads(one)), 7, recs, bad)  # a replay
    assert tuple(landed_counts(spark, recs).first()) == (130, 0, 130)


def _topic(spark, recs):
    """recs: (title, seconds, partition, offset)."""
    import datetime as dt
    path = scratch_path(spark, "topic")
    rows = [(t, None if t is None else _line(t, 0, bot=True)[6:], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), p, o)
            for t, s, p, o in recs]
    spark.createDataFrame(rows, "key string, value string, timestamp timestamp, partition int, offset bigint").write.parquet(path)
    return path


def _found(sig):
    return sorted((r.signal_type, r.title, r.edit_count, r.total_edit_count) for r in sig.collect())


def test_disorder_inside_a_partition_is_late_by_default(spark):
    """Offsets 0-3 in window 0, 4 in window 1, 5 back in window 0: the window closed before offset 5."""
    path = _topic(spark, [("A", 10 * o, 0, o) for o in range(4)] + [("A", 330, 0, 4), ("A", 50, 0, 5)])
    assert _found(detect_from_records(spark, path, TrendingParams(), BotParams(min_volume=5))) == []
    kept = detect_from_records(spark, path, TrendingParams(), BotParams(min_volume=5), late="keep")
    assert _found(kept) == [("BOT_ANOMALY", None, None, 5), ("TRENDING", "A", 5, None)]


def test_partitioned_topic_branch_clocks(spark):
    """Trending has a clock per partition. The bot branch merges the partitions by their clocks: B's
    record of minute 6 comes after A's edits, though it is the first of its partition; C, behind it,
    is late for the bot window and, in its own partition, for its trending window."""
    recs = [("B", 360, 1, 0)] + [("C", 20 + o, 1, o) for o in range(1, 7)] + [("A", o, 0, o) for o in range(10)] + [(None, 3, 0, 99)]
    sig = detect_from_records(spark, _topic(spark, recs), TrendingParams(), BotParams(min_volume=5))
    assert _found(sig) == [("BOT_ANOMALY", None, None, 10), ("TRENDING", "A", 10, None)]
    emitted = {r.signal_type: r.emitted.asDict() for r in sig.collect()}
    assert {e["offset"] for e in emitted.values()} == {9} and list(emitted["TRENDING"]) == ["record_ts", "partition", "offset"]


def test_signals_of_both_branches_order_by_record_time(spark):
    """A high offset in one partition does not outrank a later record of another."""
    from edit_signals.operators import recent_signals
    path = _topic(spark, [("A", 60 + o, 0, 1000 + o) for o in range(6)] + [("B", 600 + o, 1, o) for o in range(6)])
    sig = detect_from_records(spark, path, TrendingParams(), BotParams(min_volume=5))
    assert [r.title for r in recent_signals(sig).collect() if r.title] == ["B", "A"]


def test_merged_order_of_many_partitions_and_old_times(spark):
    """5,000 partitions, times before 1970: the first arrivals equal those of a sorted list."""
    import datetime as dt
    import random
    from pyspark.sql import functions as F
    from edit_signals.operators import first_arrivals, flag_late
    from edit_signals.sources.records import MERGED_ARRIVAL, with_clock
    rng, t0 = random.Random(3), dt.datetime(1969, 12, 31, 23, 50)
    rows = [(p, o, t0 + dt.timedelta(seconds=rng.randrange(1200))) for p in range(5000) for o in range(2)]
    df = with_clock(spark.createDataFrame(rows, "partition int, offset bigint, record_ts timestamp")
                    .withColumn("offset_bucket", F.lit(0)).withColumn("event_time", F.col("record_ts")))
    top, keyed = {}, []
    for p, o, t in rows:
        top[p] = max(top.get(p, t), t)
        keyed.append((top[p], p, o, t))
    keyed.sort()
    want, late, high = {}, set(), None
    for clock, p, o, t in keyed:
        w = dt.datetime(1969, 1, 1) + (t - dt.datetime(1969, 1, 1)) // dt.timedelta(minutes=5) * dt.timedelta(minutes=5)
        want.setdefault(w, (clock, p, o))
        high = t if high is None else max(high, t)
        if w + dt.timedelta(minutes=5) <= high:
            late.add((p, o))
    assert {r._ws: tuple(r._first) for r in first_arrivals(df, 5, MERGED_ARRIVAL).collect()} == want
    assert {(r.partition, r.offset) for r in flag_late(df, 5, MERGED_ARRIVAL).where("late").collect()} == late and late


def test_folder_grows_between_two_calls(spark):
    path = _topic(spark, [("A", 10 * o, 0, o + 1) for o in range(6)])
    first = detect_from_records(spark, path, TrendingParams(), BotParams())
    assert [r.edit_count for r in first.collect()] == [6]
    spark.read.parquet(_topic(spark, [("A", 400, 0, 0)])).write.mode("append").parquet(path)
    again = detect_from_records(spark, path, TrendingParams(), BotParams())
    assert again.collect() == []  # offset 0 comes first and closes the window
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_arrival_order_rules(spark):
    import pytest
    from edit_signals.operators import bot_revisions, flag_late
    from edit_signals.params import Arrival
    from edit_signals.sources.records import PARTITION_ARRIVAL
    from tests.conftest import make_edits
    e = make_edits(spark, [("A", False, 0)])
    with pytest.raises(ValueError, match="starts with the event time"):
        flag_late(e, 5, Arrival(order=("event_time", "arrival_id")))
    with pytest.raises(ValueError, match="one clock"):
        bot_revisions(e, BotParams(), PARTITION_ARRIVAL)


def test_offsets_follow_file_time_not_file_size(spark):
    """A one-line file written first keeps the lowest offsets though a long one is packed before it."""
    import time
    feed = scratch_path(spark, "feed")
    for lines in ([_line("first", T0)], [_line(f"late{i}", T0 + i) for i in range(50)]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(feed)
        time.sleep(1.1)
    recs = scratch_path(spark, "recs")
    ingest_feed(spark, feed, recs, scratch_path(spark, "bad"))
    keys = [r.key for r in spark.read.parquet(recs).orderBy("offset").collect()]
    assert keys == ["first", *(f"late{i}" for i in range(50))]


def test_replayed_batch_is_not_read_twice(spark):
    from edit_signals.streaming.common import write_batch_partition
    path, out, chk = (scratch_path(spark, n) for n in ("landed", "out", "chk"))
    df = spark.createDataFrame([(i,) for i in range(6)], "x int")

    def drain():
        q = (spark.readStream.schema("x int").parquet(path).writeStream.option("checkpointLocation", chk)
             .trigger(availableNow=True).format("parquet").option("path", out).start())
        q.awaitTermination(300)
        return spark.read.parquet(out).count()

    for _ in range(2):
        write_batch_partition(df, 0, path)
        assert drain() == 6


def test_work_dir_needs_a_shared_folder_on_a_cluster():
    import pytest
    from edit_signals.session import work_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Session())
