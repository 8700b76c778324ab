"""Streaming queries equal the batch operators (multi-file sources, availableNow)."""

import pytest
from pyspark.sql import functions as F

from edit_signals.functions.codec import decode_signals, encode_events
from edit_signals.operators import detect_signals
from edit_signals.params import BotParams, TrendingParams
from edit_signals.session import scratch_path
from edit_signals.sources.records import read_signal_records
from edit_signals.streaming.detect import run_detection
from edit_signals.streaming.serve import recent_view, run_serving, store_view

from .conftest import at, make_edits

MIN = 60_000
TP, BP = TrendingParams(), BotParams()
REC_DDL = "title string, bot boolean, namespace int, event_time timestamp, offset bigint"


def _land(spark, path, files):
    """files: list of lists of (title, bot, event_ms); each list becomes one file, in order."""
    off = 0
    for rows in files:
        recs = []
        for title, bot, ms in rows:
            recs.append((title, bot, 0, at(ms), off))
            off += 1
        df = spark.createDataFrame(recs, REC_DDL)
        for c, t in [("wiki", "string"), ("user", "string"), ("timestamp", "bigint"), ("type", "string"),
                     ("comment", "string"), ("revision", "struct<old:bigint,new:bigint>"),
                     ("length", "struct<old:int,new:int>")]:
            df = df.selectExpr("*", f"CAST(NULL AS {t}) AS `{c}`")
        out = encode_events(df).selectExpr("title AS key", "value", "event_time AS timestamp",
                                           "0 AS partition", "offset")
        out.coalesce(1).write.mode("append").parquet(path)


def _signals(spark, src, trending=TP, bot=BP, mode="append"):
    out = scratch_path(spark, "sig")
    run_detection(spark, src, out, scratch_path(spark, "chk"), trending=trending, bot=bot, output_mode=mode,
                  max_files_per_trigger=1, timeout_s=300)
    return decode_signals(read_signal_records(spark, out))


def test_late_row_dropped_in_stream(spark):
    src = scratch_path(spark, "src")
    _land(spark, src, [[("A", False, i * 1000) for i in range(4)], [("B", False, 6 * MIN)],
                       [("A", False, 50_000)], [("C", False, 20 * MIN)]])
    assert _signals(spark, src, bot=None).count() == 0


def test_stream_equals_batch_on_closed_windows(spark):
    files = [[("A", i % 2 == 0, i * 7_000) for i in range(12)],
             [("B", True, 90_000 + i * 3_000) for i in range(14)],
             [("A", True, 5 * MIN + i * 1000) for i in range(6)],
             [("C", False, 11 * MIN)]]
    src = scratch_path(spark, "src")
    _land(spark, src, files)
    got = sorted((r.signal_type, r.title, r.edit_count, r.bot_edit_count, r.total_edit_count, r.window_start)
                 for r in _signals(spark, src).collect())
    flat = [(t, b, ms) for f in files for t, b, ms in f]
    edits = spark.createDataFrame([(t, b, at(ms)) for t, b, ms in flat], "title string, bot boolean, event_time timestamp")
    closed_before = at(11 * MIN)
    want = sorted((r.signal_type, r.title, r.edit_count, r.bot_edit_count, r.total_edit_count, r.window_start)
                  for r in detect_signals(edits, TP, BP).collect() if r.window_end <= closed_before)
    assert got == want and len(got) == 3


def test_serving_store_and_recent(spark):
    src = scratch_path(spark, "src")
    _land(spark, src, [[("A", False, i * 1000) for i in range(5)] + [("B", False, 10_000 + i) for i in range(6)],
                       [("C", False, 6 * MIN)]])
    sig = scratch_path(spark, "sig")
    run_detection(spark, src, sig, scratch_path(spark, "chk"), trending=TP, bot=None, max_files_per_trigger=1,
                  timeout_s=300)
    log, recent = scratch_path(spark, "log"), scratch_path(spark, "recent")
    run_serving(spark, sig, log, recent, scratch_path(spark, "chk"), timeout_s=300)
    store = store_view(spark, log).collect()
    assert [r.title for r in store] == ["B"]      # same window: the later write overwrites the other
    assert store_view(spark, log, key="window_title").count() == 2
    assert sorted(r.title for r in recent_view(spark, recent).collect()) == ["A", "B"]


def test_update_mode_emits_revisions(spark):
    """update output: each micro-batch emits the windows it changed that pass the predicate."""
    src = scratch_path(spark, "src")
    _land(spark, src, [[("A", False, i * 1000) for i in range(5)], [("A", False, 10_000)],
                       [("A", False, 11_000), ("B", False, 12_000)]])
    got = sorted(r.edit_count for r in _signals(spark, src, bot=None, mode="update").collect())
    assert got == [5, 6, 7]


def test_recent_snapshots_are_retained_and_merged(spark):
    """Serving over several batches: the newest-N view merges batches, old snapshots go."""
    import os
    from edit_signals.session import local_path
    from edit_signals.streaming.serve import serve_batch
    from edit_signals.functions.codec import encode_signals
    sig_ddl = ("signal_type string, title string, edit_count int, bot_edit_count int, total_edit_count int, "
               "ratio double, window_start timestamp, window_end timestamp")
    log, recent = scratch_path(spark, "log"), scratch_path(spark, "recent")
    for b in range(4):
        rows = [("TRENDING", f"T{b}-{i}", 5, None, None, None, at(0), at(5 * MIN)) for i in range(2)]
        recs = encode_signals(spark.createDataFrame(rows, sig_ddl)).select("value", F.lit(at(b)).alias("record_ts"))
        serve_batch(recs, b, log, recent, n=3)
    titles = [r.title for r in recent_view(spark, recent).orderBy(F.col("emitted").desc()).collect()]
    assert titles[0].startswith("T3") and len(titles) == 3 and titles[2].startswith("T2")
    snaps = [d for d in os.listdir(local_path(recent)) if d.startswith("snapshot=")]
    assert len(snaps) <= 2


def test_restart_resumes_from_checkpoint(spark):
    """Stop after two files, add two more, restart on the same checkpoint: nothing is
    processed twice and the result equals one run over everything."""
    files = [[("A", False, i * 1000) for i in range(5)], [("A", False, 10_000)],
             [("B", False, 6 * MIN + i) for i in range(5)], [("C", False, 20 * MIN)]]
    src, out, chk = scratch_path(spark, "src"), scratch_path(spark, "sig"), scratch_path(spark, "chk")
    _land(spark, src, files[:2])
    run_detection(spark, src, out, chk, trending=TP, bot=None, max_files_per_trigger=1, timeout_s=300)
    first = decode_signals(read_signal_records(spark, out)).count()
    _land_more(spark, src, files[2:], start_offset=6)
    run_detection(spark, src, out, chk, trending=TP, bot=None, max_files_per_trigger=1, timeout_s=300)
    got = sorted((r.title, r.edit_count) for r in decode_signals(read_signal_records(spark, out)).collect())
    assert first == 0 and got == [("A", 6), ("B", 5)]


def _land_more(spark, path, files, start_offset):
    import time
    time.sleep(1.1)  # later modification times than the first files
    for rows in files:
        recs = [(t, b, 0, at(ms), start_offset + i) for i, (t, b, ms) in enumerate(rows)]
        start_offset += len(rows)
        df = spark.createDataFrame(recs, REC_DDL)
        for c, t in [("wiki", "string"), ("user", "string"), ("timestamp", "bigint"), ("type", "string"),
                     ("comment", "string"), ("revision", "struct<old:bigint,new:bigint>"),
                     ("length", "struct<old:int,new:int>")]:
            df = df.selectExpr("*", f"CAST(NULL AS {t}) AS `{c}`")
        encode_events(df).selectExpr("title AS key", "value", "event_time AS timestamp", "0 AS partition",
                                     "offset").coalesce(1).write.mode("append").parquet(path)


def test_replayed_batch_write_is_idempotent(spark):
    from edit_signals.streaming.common import write_batch_partition
    out = scratch_path(spark, "out")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        write_batch_partition(df, 7, out)
    write_batch_partition(df.limit(1), 8, out)
    assert spark.read.parquet(out).count() == 3


def test_store_compaction_keeps_latest_and_bounds_folders(spark):
    import os
    from edit_signals.session import local_path
    from edit_signals.streaming.serve import serve_batch
    from edit_signals.functions.codec import encode_signals
    sig_ddl = ("signal_type string, title string, edit_count int, bot_edit_count int, total_edit_count int, "
               "ratio double, window_start timestamp, window_end timestamp")
    log, recent = scratch_path(spark, "log"), scratch_path(spark, "recent")
    for b in range(5):
        rows = [("TRENDING", "A", 5 + b, None, None, None, at(0), at(5 * MIN)),
                ("TRENDING", f"T{b}", 5, None, None, None, at(5 * MIN * b), at(5 * MIN * (b + 1)))]
        recs = encode_signals(spark.createDataFrame(rows, sig_ddl)).select("value", F.lit(at(b)).alias("record_ts"))
        serve_batch(recs, b, log, recent, n=3, compact_every=2)
    by_title = {(r.sk, r.title): r.editCount for r in store_view(spark, log, key="window_title").collect()}
    import datetime as _dt
    sk0 = str(int((at(5 * MIN) - _dt.datetime(1970, 1, 1)).total_seconds() * 1000))
    assert by_title[(sk0, "A")] == 9 and len(by_title) == 6
    by_window = {r.sk: (r.title, r.editCount) for r in store_view(spark, log).collect()}
    assert len(by_window) == 5
    logs = [d for d in os.listdir(local_path(log)) if d.startswith("batch_id=")]
    views = [d for d in os.listdir(local_path(log) + "_view") if d.startswith("upto=")]
    assert logs == ["batch_id=4"] and len(views) <= 2


def test_store_takes_the_later_file_not_the_larger(spark):
    """A one-row file first, a file of 2,000 rows later, for the same window and without record times."""
    import time
    from edit_signals.functions.codec import encode_signals as enc
    ddl = ("signal_type string, title string, edit_count bigint, bot_edit_count bigint, total_edit_count bigint, "
           "ratio double, window_start timestamp, window_end timestamp")
    sig = scratch_path(spark, "sig")
    for rows in ([("early", 5)], [(f"t{i}", 6) for i in range(1999)] + [("late", 9)]):
        df = spark.createDataFrame([("TRENDING", t, n, None, None, None, at(0), at(5 * MIN)) for t, n in rows], ddl)
        enc(df).select("value").coalesce(1).write.mode("append").parquet(sig)
        time.sleep(1.1)
    log, recent = scratch_path(spark, "log"), scratch_path(spark, "recent")
    run_serving(spark, sig, log, recent, scratch_path(spark, "chk"), timeout_s=300)
    assert [(r.title, r.editCount) for r in store_view(spark, log).collect()] == [("late", 9)]
    assert "early" not in {r.title for r in recent_view(spark, recent).collect()}


def test_detection_reads_its_input_once(spark, tmp_path):
    """Both detectors share one scan and one state: a record is read once per query."""
    from edit_signals.functions import codec
    from edit_signals.operators import key_by_title
    from edit_signals.streaming.detect import open_windows, run_detection
    rows = [(f"T{i % 3}", i % 2 == 0, i * 20_000) for i in range(120)]
    edits = make_edits(spark, rows)
    full = edits.selectExpr("title", "wiki", "'u' AS user", "bot", "0L AS timestamp", "'edit' AS type", "'' AS comment", "namespace",
                            "CAST(NULL AS struct<old:bigint,new:bigint>) AS revision", "CAST(NULL AS struct<old:int,new:int>) AS length",
                            "event_time", "arrival_id")
    recs = codec.encode_events(key_by_title(full)).selectExpr(
        "key", "value", "event_time AS timestamp", "0 AS partition", "arrival_id AS offset")
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    recs.write.parquet(src)
    tp, bp = TrendingParams(10, 4), BotParams(5, 0.4, 10)
    q = run_detection(spark, src, out, chk, trending=tp, bot=bp)
    assert sum(p["numInputRows"] for p in q.recentProgress) == len(rows)
    assert {len(p["stateOperators"]) for p in q.recentProgress} == {1}
    cols = ["signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "window_start", "window_end"]
    from edit_signals.operators import detect_signals
    from edit_signals.sources.records import read_signal_records
    closed = codec.decode_signals(read_signal_records(spark, out)).select(*cols)
    still_open = open_windows(spark, chk, tp, bp).select(*cols)
    want = detect_signals(edits, tp, bp).select(*cols)
    assert still_open.count() > 0
    assert sorted(map(str, closed.unionByName(still_open).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("key", ["window", "window_title"])
@pytest.mark.parametrize("wide", [False, True])
def test_latest_items_without_sort_aggregates(spark, key, wide):
    """Greatest arrival per key, ties by title; packed and prefix form, nulls before everything else."""
    import random
    from edit_signals.operators.store import ITEM_COLUMNS, latest_items
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        arrival = (at(rnd.choice([0, 1, 2])) if rnd.random() < 0.9 else None, rnd.choice([None, 0, 1]),
                   rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"]))
        arrival = arrival if wide else arrival[:2]
        rows.append((rnd.choice("PQ"), str(rnd.randrange(3)), None, i, i, rnd.choice([None, "x", "y"]), i, i, i, 0.5, arrival))
    for i, r in enumerate(rows):
        rows[i] = (r[0], r[1], r[0], *r[3:])
    emitted = "struct<t:timestamp,p:int" + (",o:bigint,s:string>" if wide else ">")
    ddl = ("pk string, sk string, signalType string, windowStart bigint, windowEnd bigint, title string, editCount bigint, "
           "botEditCount bigint, totalEditCount bigint, ratio double, emitted " + emitted)
    df = spark.createDataFrame(rows, ddl)
    out = latest_items(df, key)
    assert out.columns == ITEM_COLUMNS
    low = lambda v: (v is not None, v if v is not None else 0)
    best = {}
    for r in rows:
        k = (r[0], r[1]) + ((r[5],) if key == "window_title" else ())
        rank = tuple(map(low, r[10])) + (low(r[5]),)
        best.setdefault(k, []).append((rank, r))
    got = {tuple(getattr(r, c) for c in ("pk", "sk") + (("title",) if key == "window_title" else ())): r for r in out.collect()}
    assert set(got) == set(best)
    for k, found in best.items():
        top = max(x for x, _ in found)
        assert got[k].windowStart in [r[3] for x, r in found if x == top]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
