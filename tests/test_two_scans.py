"""Shared panes, bucket bounds and arrival buckets: brute force and scan counts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from edit_signals.operators import detect_signals, first_crossing, flag_late_by, signal_revisions, trending_revisions
from edit_signals.params import Arrival, BotParams, TrendingParams, window_micros
from edit_signals.sources.records import FILE_ARRIVAL, with_arrival_columns
from edit_signals.streaming.ingest import split_ranks

from .conftest import at, make_edits

MIN = 60_000


def rows_at_random(seed, n=500, titles=5):
    rnd = random.Random(seed)
    rows, t = [], 0
    for _ in range(n):
        t += rnd.choice([0, 0, 500, 9_000, 40_000])
        ev = t - (rnd.randint(0, 12 * MIN) if rnd.random() < 0.2 else 0)
        rows.append((rnd.choice([f"T{rnd.randrange(titles)}", None, ""]) if rnd.random() < 0.3 else "T0", rnd.random() < 0.8, max(ev, 0), t))
    return rows


def brute(rows, t_ms, threshold, b_ms, ratio, volume):
    """(revisions, first crossings) of both detectors, record by record."""
    hw, n, out = -1, {}, []
    for i, (title, bot, ev, _) in enumerate(rows):
        hw = max(hw, ev)
        if title is not None and (ev // t_ms + 1) * t_ms > hw:
            k = ("TRENDING", ev // t_ms * t_ms, title)
            n[k] = n.get(k, 0) + 1
            if n[k] >= threshold:
                out.append((*k, n[k], None, None, i))
        if (ev // b_ms + 1) * b_ms > hw:
            k = ("BOT_ANOMALY", ev // b_ms * b_ms, None)
            total, bots = n.get(k, (0, 0))
            n[k] = total + 1, bots + bot
            if n[k][0] >= volume and n[k][1] / n[k][0] > ratio:
                out.append((*k, None, *n[k], i))
    first = {}
    for r in out:
        first.setdefault(r[:3], r)
    return out, list(first.values())


def plain(df):
    start = F.unix_millis("window_start") - F.lit(1704067200000)
    cols = ["signal_type", start.alias("ws"), "title", "edit_count", "total_edit_count", "bot_edit_count", "emitted.arrival_id"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seed, t_min, b_min, bucket_ms", [(0, 5, 5, 60_000), (1, 15, 5, 1_000), (2, 7, 5, 100_000_000), (3, 5, 15, 30_000)])
def test_both_detectors_match_brute_force(spark, seed, t_min, b_min, bucket_ms):
    rows = rows_at_random(seed)
    # windows are epoch aligned and the base time is a whole number of these widths after the epoch only for divisors of a day
    shift = 1704067200000
    shifted = [(t, b, ev + shift, arr + shift) for t, b, ev, arr in rows]
    want, first = brute(shifted, t_min * MIN, 4, b_min * MIN, 0.75, 6)
    edits = make_edits(spark, rows, bucket_ms)
    tp, bp = TrendingParams(t_min, 4), BotParams(b_min, 0.75, 6)
    norm = lambda rs: sorted(((s, ws - shift, t, n, total, bots, i) for s, ws, t, n, total, bots, i in rs), key=str)
    got = signal_revisions(edits, tp, bp)
    assert plain(got) == norm(want)
    assert plain(first_crossing(signal_revisions(edits, tp, bp, first=True))) == norm(first)
    assert plain(trending_revisions(edits, tp)) == norm([r for r in want if r[0] == "TRENDING"])


def test_late_flags_of_both_widths_from_one_table(spark):
    rows = rows_at_random(7)
    got = flag_late_by(make_edits(spark, rows), {"a": 5, "b": 15, "c": 2}, fanout=3).orderBy("arrival_id").collect()
    hw = -1
    for (_, _, ev, _), r in zip(rows, got):
        hw = max(hw, ev)
        for c, w in (("a", 5), ("b", 15), ("c", 2)):
            assert r[c] == ((ev // (w * MIN) + 1) * w * MIN <= hw)


def scans(df) -> int:
    """Scans of the input in the final plan; reused exchanges count once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan", plan))


def test_input_is_scanned_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "edits")
    make_edits(spark, rows_at_random(4)).write.parquet(path)
    edits = spark.read.parquet(path)
    tp, bp = TrendingParams(15, 4), BotParams(5, 0.75, 6)
    assert scans(first_crossing(signal_revisions(edits, tp, bp, first=True))) <= 2
    assert scans(trending_revisions(edits, tp)) <= 2
    assert scans(detect_signals(edits, tp, bp, arrival=Arrival(), late="drop")) <= 2


def test_quiet_buckets_leave_before_the_row_window(spark):
    """Bot windows: of 100 buckets only those whose ratio can pass are sorted row by row."""
    rows = [("A", k >= 990, k, k) for k in range(1_000)] + [("A", True, 1_000 + k, 1_000 + k) for k in range(4_000)]
    edits = make_edits(spark, rows, 50)
    df = signal_revisions(edits, TrendingParams(5, 10 ** 6), BotParams(5, 0.8, 10), first=True)
    df.collect()
    metrics = {}

    def walk(p):
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name == "Window":
            child = p.child()
            while not child.metrics().contains("numOutputRows"):
                child = child.children().head() if "QueryStage" not in child.nodeName() else child.plan()
            metrics.setdefault("rows", []).append(child.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    # the ratio passes 0.8 once 3,951 of 4,940 and more are bots: the top window sees one bucket of 50 rows
    assert 0 < metrics["rows"][0] <= 50


# -- arrival buckets of landed batches ------------------------------------------------------------

def test_buckets_of_many_splits_keep_the_order(spark):
    """Split ranks above 2^20: buckets of batch 0 stay below those of batch 1."""
    rnd = random.Random(3)
    ranks = [0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 1 << 29, (1 << 30) - 1]
    rows, t = [], 0
    for batch in (0, 1, 7, (1 << 33) - 1):
        for rank in ranks:
            for place in range(3):
                t += 20_000
                ev = max(0, t - (rnd.randint(0, 9 * MIN) if rnd.random() < 0.3 else 0))
                rows.append((batch, (rank << 33) | place, "T", True, at(ev), ev))
    df = spark.createDataFrame([r[:5] for r in rows], "batch_id bigint, offset bigint, title string, bot boolean, record_ts timestamp")
    edits = with_arrival_columns(df)
    order = edits.orderBy("batch_id", "offset").select("file_bucket").collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order) and len({r[0] for r in order}) == len(ranks) * 4
    hw, n, want = -1, {}, []
    for batch, offset, _, _, _, ev in rows:
        hw = max(hw, ev)
        w = ev // (5 * MIN)
        if (w + 1) * 5 * MIN > hw:
            n[w] = n.get(w, 0) + 1
            if n[w] >= 5:
                want.append((batch, offset, n[w]))
    got = trending_revisions(edits, TrendingParams(), FILE_ARRIVAL).select("emitted.batch_id", "emitted.offset", "edit_count")
    assert sorted(map(tuple, got.collect())) == want and want


def test_bucket_out_of_range_fails(spark):
    df = spark.createDataFrame([(1 << 33, 0, "T", True, at(0))], "batch_id bigint, offset bigint, title string, bot boolean, record_ts timestamp")
    with pytest.raises(Exception, match="out of range"):
        with_arrival_columns(df).collect()


def test_split_ranks_are_the_global_order(spark):
    rnd = random.Random(6)
    rows = sorted({(at(rnd.choice([0, 1_000, 59_000, 61_000, 500_000])), f"f{rnd.randrange(6)}", rnd.randrange(4) * 100) for _ in range(80)})
    shuffled = rnd.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "_feed_time timestamp, _feed_file string, _feed_start bigint").repartition(5)
    got = {(r["_feed_time"], r["_feed_file"], r["_feed_start"]): r["_rank"] for r in split_ranks(df).collect()}
    assert got == {r: i for i, r in enumerate(rows)}


def test_window_micros():
    assert window_micros(5) == 300_000_000 and window_micros("1 hour 30 minutes") == 5_400_000_000
    assert window_micros("interval 2 weeks") == 14 * 86_400_000_000 and window_micros("250 milliseconds") == 250_000
    for bad in ("1 month", "x", "0 seconds", "5 minutes soon"):
        with pytest.raises(ValueError):
            window_micros(bad)
