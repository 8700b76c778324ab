"""Live lists: compaction of landed topics and of the store, readers across it."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from edit_signals import schemas as S
from edit_signals.functions.codec import encode_signals
from edit_signals.streaming.common import batch_folder
from edit_signals.streaming.landed import (commit_batch, compact_landed, consume_landed, live_folders, read_landed)
from edit_signals.streaming.serve import compact_store, serve_batch, store_view

from .conftest import at


def land(root, batch_id, n):
    folder = batch_folder(root, batch_id)
    os.makedirs(folder)
    rows = {"key": pa.array([f"k{batch_id}"] * n, pa.string()), "value": pa.array([f"{batch_id}-{i}" for i in range(n)], pa.string()),
            "timestamp": pa.array([at(batch_id * 1000)] * n, pa.timestamp("us", "UTC")), "partition": pa.array([0] * n, pa.int32()),
            "offset": pa.array(list(range(n)), pa.int64())}
    pq.write_table(pa.table(rows), f"{folder}/part-0.parquet")
    open(f"{folder}/_SUCCESS", "w").close()


def files(root):
    return sum(f.endswith(".parquet") for base in (root, f"{root}_compacted") for _, _, fs in os.walk(base) for f in fs)


def test_compaction_bounds_files_and_readers_see_records_once(spark, tmp_path):
    root, position = str(tmp_path / "topic"), str(tmp_path / "position")
    rnd, want, seen, most = random.Random(4), [], [], 0
    for b in range(30):
        n = rnd.choice([0, 1, 3])
        land(root, b, n)
        commit_batch(spark, root, b)
        commit_batch(spark, root, b)  # a replay changes nothing
        want += [(b, f"{b}-{i}") for i in range(n)]
        if (b + 1) % 3 == 0:
            held = read_landed(spark, root, S.EVENT_RECORD)  # a reader that took the list before the compaction
            compact_landed(spark, root, S.EVENT_RECORD, 3, ("offset",))
            assert sorted((r.batch_id, r.value) for r in held.collect()) == want
            most = max(most, files(root))
        if b in (1, 2, 10, 25, 29):
            consume_landed(spark, root, S.EVENT_RECORD, position, lambda rows, last: seen.extend(
                (r.batch_id, r.value) for r in rows.collect()))
    assert sorted(seen) == want and len(set(seen)) == len(seen)
    assert sorted((r.batch_id, r.value) for r in read_landed(spark, root, S.EVENT_RECORD).collect()) == want
    folders = live_folders(spark, root)
    assert [f[1] for f in folders] == sorted(f[1] for f in folders) and len(folders) <= 3 * 4
    assert most <= 2 * 3 * 4 and len(os.listdir(f"{root}_live")) <= 3
    some = read_landed(spark, root, S.EVENT_RECORD, after=4, upto=12).collect()
    assert sorted((r.batch_id, r.value) for r in some) == [w for w in want if 4 < w[0] <= 12]
    assert consume_landed(spark, root, S.EVENT_RECORD, position, lambda rows, last: 1 / 0) is None  # nothing new


def test_consumer_that_fails_gets_its_records_again(spark, tmp_path):
    root, position = str(tmp_path / "topic"), str(tmp_path / "position")
    for b in range(3):
        land(root, b, 2)
        commit_batch(spark, root, b)
    try:
        consume_landed(spark, root, S.EVENT_RECORD, position, lambda rows, last: 1 / 0)
    except ZeroDivisionError:
        pass
    got = []
    for _ in range(3):
        consume_landed(spark, root, S.EVENT_RECORD, position, lambda rows, last: got.append((last, rows.count())), batches=2)
    assert got == [(1, 4), (2, 2)]


def signal_frame(spark, rows):
    sig = spark.createDataFrame(
        [("TRENDING", t, n, None, None, None, at(d * 86_400_000), at(d * 86_400_000 + 3_600_000), t) for t, n, d in rows],
        "signal_type string, title string, edit_count bigint, bot_edit_count bigint, total_edit_count bigint, ratio double, "
        "window_start timestamp, window_end timestamp, key string")
    return encode_signals(sig).selectExpr("value", "current_timestamp() AS record_ts", "0 AS partition", "CAST(edit_count AS BIGINT) AS offset")


def day_files(view):
    return {os.path.join(os.path.basename(d), f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(view) for f in fs if f.endswith(".parquet")}


def test_store_compaction_leaves_untouched_days_alone(spark, tmp_path):
    log, recent, view = str(tmp_path / "log"), str(tmp_path / "recent"), str(tmp_path / "log_view")
    serve_batch(signal_frame(spark, [("A", 5, 0), ("B", 6, 1), ("C", 7, 2)]), 0, log, recent, compact_every=None)
    compact_store(spark, log, 0)
    first = day_files(view)
    assert {f.split("/")[0] for f in first} == {"day=2024-01-01", "day=2024-01-02", "day=2024-01-03"}
    serve_batch(signal_frame(spark, [("B", 9, 1), ("D", 8, 3)]), 1, log, recent, compact_every=None)
    held = store_view(spark, log, "window_title")
    compact_store(spark, log, 1)
    second = day_files(view)
    kept = {f: t for f, t in first.items() if not f.startswith("day=2024-01-02")}
    assert all(second[f] == t for f, t in kept.items())  # same files, not written again
    want = [("A", 5), ("B", 9), ("C", 7), ("D", 8)]
    now = lambda: sorted((r.title, r.editCount) for r in store_view(spark, log, "window_title").collect())
    assert now() == want
    serve_batch(signal_frame(spark, [("B", 11, 1)]), 2, log, recent, compact_every=None)
    compact_store(spark, log, 2)
    compact_store(spark, log, 2)  # again: nothing changes
    assert now() == [("A", 5), ("B", 11), ("C", 7), ("D", 8)]
    # of day 2 the first compaction's folder went, the last two lists' stay
    assert sorted(os.listdir(view)) == ["upto=000000000000", "upto=000000000001", "upto=000000000002"]
    assert "day=2024-01-02" not in os.listdir(f"{view}/upto=000000000000")
    assert os.listdir(log) == [] or all(not n.startswith("batch_id=") for n in os.listdir(log))
    del held
