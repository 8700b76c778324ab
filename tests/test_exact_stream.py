"""Exact detection in micro-batches: the rows of the batch operators wherever the input is cut."""

import os
import random

import pytest
from pyspark.sql import functions as F

from edit_signals.functions.codec import decode_signals
from edit_signals.params import BotParams, TrendingParams
from edit_signals.sources.records import LOG_ARRIVAL, PARTITION_ARRIVAL, read_signal_records
from edit_signals.streaming.exact import exact_batch, open_signals, start_exact_detection

from .conftest import at
from .test_two_scans import MIN, brute, rows_at_random

TP, BP = TrendingParams(15, 4), BotParams(5, 0.75, 6)
SHIFT = 1704067200000
EDITS = "title string, bot boolean, event_time timestamp, record_ts timestamp, partition int, offset bigint, offset_bucket bigint"


def frame(spark, rows, first=0, partition=lambda i: 0):
    return spark.createDataFrame([(t, b, at(ev), at(ev), partition(first + i), first + i, (first + i) // 7)
                                  for i, (t, b, ev, _) in enumerate(rows)], EDITS)


def found(df):
    start = F.unix_millis("window_start") - F.lit(SHIFT)
    return sorted((tuple(r) for r in df.select("signal_type", start.alias("ws"), "title", "edit_count", "total_edit_count",
                                               "bot_edit_count", "offset").collect()), key=str)


def landed(spark, path):
    return decode_signals(read_signal_records(spark, path))


def expected(rows):
    shifted = [(t, b, ev + SHIFT, arr) for t, b, ev, arr in rows]
    updates, _ = brute(shifted, 15 * MIN, 4, 5 * MIN, 0.75, 6)
    norm = [(s, ws - SHIFT, t, n, total, bots, i) for s, ws, t, n, total, bots, i in updates]
    # final state of a window: all records it accepts, whether or not the last of them passes
    every, _ = brute(shifted, 15 * MIN, 1, 5 * MIN, -1.0, 1)
    last = {}
    for r in every:
        last[r[:3]] = r
    finals = [(s, ws - SHIFT, t, n, total, bots, i) for s, ws, t, n, total, bots, i in last.values()
              if (n is not None and n >= 4) or (n is None and total >= 6 and bots / total > 0.75)]
    return sorted(norm, key=str), sorted(finals, key=str)


def feed(spark, rows, cuts, tmp, emit):
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        exact_batch(frame(spark, rows[a:b], a), k, f"{tmp}/signals", f"{tmp}/state", TP, BP, LOG_ARRIVAL, emit)


@pytest.mark.parametrize("seed, cuts", [(11, [0, 1, 70, 70, 71, 160]), (12, [0, 80, 160])])
def test_updates_do_not_depend_on_the_cuts(spark, tmp_path, seed, cuts):
    rows = rows_at_random(seed, 160)
    feed(spark, rows, cuts, tmp_path, "updates")
    assert found(landed(spark, f"{tmp_path}/signals")) == expected(rows)[0]


def test_final_signals_replay_and_crash(spark, tmp_path):
    rows = rows_at_random(13, 160)
    cuts = [0, 50, 110, 160]
    feed(spark, rows, cuts, tmp_path, "final")
    state = f"{tmp_path}/state"
    assert sorted(os.listdir(f"{state}/clock")) == ["version=000000000001", "version=000000000002"]

    def result():
        still_open = open_signals(spark, state, TP, BP).select("*", "emitted.offset")
        both = landed(spark, f"{tmp_path}/signals").unionByName(still_open, allowMissingColumns=True)
        return found(both)

    assert result() == expected(rows)[1]
    # a batch that has its version is skipped when it comes again, whatever it holds
    exact_batch(frame(spark, rows[:3]), 2, f"{tmp_path}/signals", state, TP, BP, LOG_ARRIVAL, "final")
    assert result() == expected(rows)[1]
    # one that was cut short before its version was complete is done again from the version before
    os.remove(f"{state}/clock/version=000000000002/_SUCCESS")
    exact_batch(frame(spark, rows[110:], 110), 2, f"{tmp_path}/signals", state, TP, BP, LOG_ARRIVAL, "final")
    assert result() == expected(rows)[1]


def test_clock_per_partition(spark, tmp_path):
    """Keyed topic: each partition closes its own windows."""
    rnd, rows, t = random.Random(5), [], 0
    for i in range(80):
        t += 30_000
        rows.append((f"T{i % 4}", False, max(0, t - rnd.choice([0, 0, 20 * MIN if i % 2 else 0])), t))
    for k, (a, b) in enumerate(((0, 33), (33, 80))):
        exact_batch(frame(spark, rows[a:b], a, lambda i: i % 2), k, f"{tmp_path}/s", f"{tmp_path}/st", TP, None, PARTITION_ARRIVAL)
    want = []
    for part in (0, 1):
        hw, n = -1, {}
        for i, (title, _, ev, _) in enumerate(rows):
            if i % 2 == part:
                hw = max(hw, ev)
                if (ev // (15 * MIN) + 1) * 15 * MIN > hw:
                    k = (ev // (15 * MIN) * 15 * MIN, title)
                    n[k] = n.get(k, 0) + 1
                    if n[k] >= 4:
                        want.append(("TRENDING", *k, n[k], None, None, i))
    assert found(landed(spark, f"{tmp_path}/s")) == sorted(want, key=str) and want


def test_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError, match="one clock"):
        start_exact_detection(spark, "x", "y", "z", "c", TP, BP, PARTITION_ARRIVAL)
    with pytest.raises(ValueError, match="emit"):
        start_exact_detection(spark, "x", "y", "z", "c", emit="all")
    with pytest.raises(ValueError, match="detector"):
        start_exact_detection(spark, "x", "y", "z", "c", None, None)
    assert open_signals(spark, str(tmp_path / "none"), TP, BP) is None
