"""Zero-grace lateness and emit-on-update revisions, checked against brute force."""

import random

import pandas as pd

from edit_signals.operators import (bot_revisions, drop_late, first_crossing, flag_late, running_totals,
                                    trending_revisions, trending_signals)
from edit_signals.params import Arrival, BotParams, TrendingParams

from .conftest import make_edits

MIN = 60_000
TP, BP = TrendingParams(), BotParams()


def test_late_record_after_later_window_is_dropped(spark):
    # 4 edits in window 0, then one in window 1 arrives, then a 5th edit for window 0 arrives late.
    e = make_edits(spark, [("A", False, i * 1000) for i in range(4)] + [("B", False, 6 * MIN)]
                   + [("A", False, 50_000, 6 * MIN + 1)])
    assert trending_signals(e, TP).count() == 1          # without lateness: 5 edits
    assert trending_signals(e, TP, arrival=Arrival(), late="drop").count() == 0
    assert [r.arrival_id for r in flag_late(e, 5).filter("late").collect()] == [5]


def test_record_at_high_water_mark_boundary(spark):
    # seen max = exactly the end of window 0 -> window 0 is closed
    e = make_edits(spark, [("B", False, 5 * MIN), ("A", False, 1000, 5 * MIN + 1)])
    assert [r.late for r in flag_late(e, 5).orderBy("arrival_id").collect()] == [False, True]
    e2 = make_edits(spark, [("B", False, 5 * MIN - 1), ("A", False, 1000, 5 * MIN + 1)])
    assert [r.late for r in flag_late(e2, 5).orderBy("arrival_id").collect()] == [False, False]


def _random_rows(seed, n=400, titles=4, bot_p=0.85, late_p=0.2):
    rnd = random.Random(seed)
    rows, t = [], 0
    for _ in range(n):
        t += rnd.randint(0, 40_000)
        ev = t - (rnd.randint(0, 12 * MIN) if rnd.random() < late_p else 0)
        rows.append((f"T{rnd.randrange(titles)}", rnd.random() < bot_p, max(ev, 0), t))
    return rows


def _brute_late(rows, width_ms):
    hw, out = -1, []
    for title, bot, ev, arr in rows:
        hw = max(hw, ev)
        out.append((ev // width_ms + 1) * width_ms <= hw)
    return out


def test_lateness_matches_running_max(spark):
    for seed in range(3):
        rows = _random_rows(seed)
        got = [r.late for r in flag_late(make_edits(spark, rows), 5).orderBy("arrival_id").collect()]
        assert got == _brute_late(rows, 5 * MIN)


def _brute_revisions(rows, width_ms, key):
    """Running state per window over non-late rows, in arrival order."""
    late = _brute_late(rows, width_ms)
    state, out = {}, []
    for i, ((title, bot, ev, arr), lt) in enumerate(zip(rows, late)):
        if lt:
            continue
        k = (ev // width_ms, title if key else None)
        tot, b = state.get(k, (0, 0))
        state[k] = (tot + 1, b + bot)
        out.append((i, k, tot + 1, b + bot))
    return out


def test_trending_revisions_match_brute_force(spark):
    rows = _random_rows(7, n=500, titles=3)
    e = make_edits(spark, rows, bucket_ms=20_000)   # small buckets: hot groups are split
    got = sorted((r.emitted.arrival_id, r.title, r.edit_count)
                 for r in trending_revisions(e, TP, Arrival()).collect())
    want = sorted((i, k[1], n) for i, k, n, _ in _brute_revisions(rows, 5 * MIN, True) if n >= 5)
    assert got == want and len(got) > 10


def test_bot_revisions_match_brute_force(spark):
    rows = _random_rows(11, n=600)
    e = make_edits(spark, rows, bucket_ms=15_000)
    got = sorted((r.emitted.arrival_id, r.total_edit_count, r.bot_edit_count)
                 for r in bot_revisions(e, BP, Arrival()).collect())
    want = sorted((i, n, b) for i, k, n, b in _brute_revisions(rows, 5 * MIN, False) if n >= 10 and b / n > 0.8)
    assert got == want and len(got) > 5


def test_revisions_grow_and_last_equals_final(spark):
    e = make_edits(spark, [("A", False, i * 20_000) for i in range(7)])
    revs = [r.edit_count for r in trending_revisions(e, TP, Arrival()).orderBy("emitted").collect()]
    assert revs == [5, 6, 7]
    final = trending_signals(e, TP).first()
    assert final.edit_count == revs[-1]


def test_bot_ratio_falls_after_crossing(spark):
    # 10 bot then 10 human: a revision is raised at 10/10, the final state 10/20 is not a signal
    e = make_edits(spark, [(f"b{i}", True, i * 1000) for i in range(10)] + [(f"h{i}", False, 20_000 + i) for i in range(10)])
    revs = bot_revisions(e, BP, Arrival()).orderBy("emitted").collect()
    # 10/10, 10/11, 10/12 still exceed 0.8; 10/13 and later do not
    assert [(r.bot_edit_count, r.total_edit_count) for r in revs] == [(10, 10), (10, 11), (10, 12)]
    from edit_signals.operators import bot_anomaly_signals
    assert bot_anomaly_signals(e, BP).count() == 0
    fc = first_crossing(bot_revisions(e, BP, Arrival())).collect()
    assert [(r.bot_edit_count, r.total_edit_count) for r in fc] == [(10, 10)]


def test_running_totals_hot_group_split(spark):
    """One group holding every row, many buckets: totals still equal a plain cumulative sum."""
    rows = [("A", i % 3 == 0, i * 100) for i in range(3000)]
    e = make_edits(spark, rows, bucket_ms=1000)   # 300 buckets
    from pyspark.sql import functions as F
    out = running_totals(e.withColumn("g", F.lit(1)), ["g"], Arrival(), {"n": F.lit(1), "b": F.col("bot").cast("int")})
    got = out.orderBy("arrival_id").select("n", "b").toPandas()
    want = pd.DataFrame({"n": range(1, 3001), "b": pd.Series([i % 3 == 0 for i in range(3000)]).cumsum()})
    assert got["n"].tolist() == want["n"].tolist() and got["b"].tolist() == want["b"].tolist()


def test_drop_late_scoped_by_partition(spark):
    from pyspark.sql import functions as F
    e = make_edits(spark, [("A", False, 6 * MIN), ("A", False, 1000, 6 * MIN + 1)])
    e = e.withColumn("p", F.col("arrival_id") % 2)
    scoped = Arrival(partitions=("p",))
    assert drop_late(e, 5, scoped).count() == 2      # each partition has its own clock
    assert drop_late(e, 5, Arrival()).count() == 1


def test_lateness_two_level_scan(spark):
    """Tiny blocks (fanout 2): the two-level suffix scan gives the same flags as the running max."""
    rows = _random_rows(5, n=300, late_p=0.3)
    got = [r.late for r in flag_late(make_edits(spark, rows), 1, fanout=2).orderBy("arrival_id").collect()]
    assert got == _brute_late(rows, 1 * MIN)


def test_running_totals_three_levels(spark):
    from pyspark.sql import functions as F
    rows = _random_rows(3, n=400, titles=2)
    e = make_edits(spark, rows, bucket_ms=5_000).withColumn("g", F.lit(1))
    out = running_totals(e, ["g", "title"], Arrival(), {"n": F.lit(1)}, levels=3, fanout=4)
    got = {r.arrival_id: r.n for r in out.collect()}
    seen = {}
    for i, (title, *_rest) in enumerate(rows):
        seen[title] = seen.get(title, 0) + 1
        assert got[i] == seen[title]


def test_packed_arrival_key_orders_like_the_struct(spark):
    from pyspark.sql import functions as F
    from edit_signals.operators.arrival import arrival_key
    import pytest
    rows = [(at_, i) for i, at_ in enumerate([3, 1, 1, 2, 0])]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "s bigint, i bigint").withColumn(
        "ts", F.timestamp_seconds("s"))
    a = Arrival(order=("ts", "i"))
    keyed = df.select("s", "i", arrival_key(df, a).alias("k")).orderBy("k").collect()
    assert [(r.s, r.i) for r in keyed] == sorted((r[0], r[1]) for r in rows)
    nulls = spark.createDataFrame([(None, 1)], "ts timestamp, i bigint")
    assert nulls.select(arrival_key(nulls, a).alias("k")).first().k is None
    neg = spark.createDataFrame([(1, -5)], "s bigint, i bigint").withColumn("ts", F.timestamp_seconds("s"))
    with pytest.raises(Exception):
        neg.select(arrival_key(neg, a)).collect()


def test_shared_revisions_equal_separate_pipelines(spark):
    from edit_signals.operators import signal_revisions
    rows = _random_rows(21, n=500, titles=3, late_p=0.25)
    e = make_edits(spark, rows, bucket_ms=10_000)
    tp, bp = TrendingParams(window=5, threshold=4), BotParams(window=10, ratio_threshold=0.7, min_volume=6)
    cols = ["signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "ratio", "window_start",
            "emitted"]
    shared = sorted(tuple(r) for r in signal_revisions(e, tp, bp, Arrival()).select(*cols).collect())
    separate = trending_revisions(e, tp, Arrival()).unionByName(bot_revisions(e, bp, Arrival()),
                                                                allowMissingColumns=True)
    assert shared == sorted(tuple(r) for r in separate.select(*cols).collect()) and len(shared) > 20


def test_last_trending_revision_equals_final_signal(spark):
    """Seeded random events: per window, the latest trending revision is the final signal
    (the count only grows, so the last emitted state is the final one)."""
    rows = _random_rows(33, n=600, titles=4, late_p=0.2)
    e = make_edits(spark, rows, bucket_ms=7_000)
    tp = TrendingParams(window=5, threshold=4)
    from pyspark.sql import functions as F
    last = {(r.title, r.window_start): r.n for r in trending_revisions(e, tp, Arrival())
            .groupBy("title", "window_start").agg(F.max("edit_count").alias("n")).collect()}
    final = {(r.title, r.window_start): r.edit_count
             for r in trending_signals(e, tp, arrival=Arrival(), late="drop").collect()}
    assert last == final and len(final) > 5


def test_shared_detect_with_lateness_equals_separate_branches(spark):
    from edit_signals.operators import bot_anomaly_signals, detect_signals
    rows = _random_rows(41, n=500, titles=3, late_p=0.3)
    e = make_edits(spark, rows, bucket_ms=10_000)
    tp, bp = TrendingParams(window=5, threshold=4), BotParams(window=10, ratio_threshold=0.7, min_volume=6)
    cols = ["signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "ratio", "window_start",
            "emitted"]
    shared = sorted(tuple(r) for r in detect_signals(e, tp, bp, Arrival(), late="drop").select(*cols).collect())
    separate = trending_signals(e, tp, arrival=Arrival(), late="drop").unionByName(
        bot_anomaly_signals(e, bp, arrival=Arrival(), late="drop"), allowMissingColumns=True)
    assert shared == sorted(tuple(r) for r in separate.select(*cols).collect()) and len(shared) > 5


def test_packed_times_before_1970(spark):
    import datetime as dt
    from edit_signals.operators.arrival import arrival_key
    rows = [(dt.datetime(1969, 12, 31), 5), (dt.datetime(1, 1, 2), 2 ** 62), (dt.datetime(9999, 1, 1), 0), (dt.datetime(1969, 12, 31), 4)]
    df = spark.createDataFrame(rows, "ts timestamp, i bigint")
    got = [(r.ts, r.i) for r in df.orderBy(arrival_key(df, Arrival(order=("ts", "i")))).collect()]
    assert got == sorted(rows)


def test_first_crossing_of_pruned_revisions(spark):
    from edit_signals.operators import first_crossing, signal_revisions
    rows = _random_rows(51, n=600, titles=3, late_p=0.2)
    e = make_edits(spark, rows, bucket_ms=4_000)
    tp, bp = TrendingParams(window=5, threshold=4), BotParams(window=10, ratio_threshold=0.6, min_volume=6)
    every = first_crossing(signal_revisions(e, tp, bp, Arrival())).collect()
    assert sorted(map(tuple, every), key=str) == sorted(
        map(tuple, first_crossing(signal_revisions(e, tp, bp, Arrival(), first=True)).collect()), key=str) and len(every) > 5
