"""Trending and bot-anomaly detection (cases of the reference's detector and topology tests)."""

from edit_signals.operators import bot_anomaly_signals, detect_signals, trending_signals
from edit_signals.params import BotParams, TrendingParams

from .conftest import at, make_edits

MIN = 60_000
TP, BP = TrendingParams(), BotParams()  # 5 min / 5 edits; 5 min / 0.8 / 10


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.signal_type, r.title or "", r.window_start))


def test_four_edits_then_next_window_no_trend(spark):
    e = make_edits(spark, [("A", False, i * 30_000) for i in range(4)] + [("A", False, 5 * MIN + 1)])
    assert trending_signals(e, TP).count() == 0


def test_five_edits_trend(spark):
    r = rows(trending_signals(make_edits(spark, [("A", False, i * 30_000) for i in range(5)]), TP))
    assert [(x.title, x.edit_count) for x in r] == [("A", 5)]


def test_six_edits_final_count(spark):
    r = rows(trending_signals(make_edits(spark, [("A", False, i * 20_000) for i in range(6)]), TP))
    assert [(x.title, x.edit_count) for x in r] == [("A", 6)]


def test_independent_titles(spark):
    e = make_edits(spark, [("A", False, i * 10_000) for i in range(5)] + [("B", False, i * 10_000) for i in range(3)])
    assert [x.title for x in rows(trending_signals(e, TP))] == ["A"]


def test_window_bounds(spark):
    r = rows(trending_signals(make_edits(spark, [("A", False, i * 10_000) for i in range(5)]), TP))[0]
    assert r.window_start == at(0) and r.window_end == at(5 * MIN)
    assert (r.window_end - r.window_start).total_seconds() * 1000 == 300_000
    assert r.key == "A" and r.bot_edit_count is None and r.ratio is None


def test_edge_record_goes_to_next_window(spark):
    e = make_edits(spark, [("A", False, i * 10_000) for i in range(4)] + [("A", False, 5 * MIN)])
    assert trending_signals(e, TP).count() == 0


def test_same_title_two_wikis_count_together(spark):
    e = make_edits(spark, [("A", False, i * 1000, i * 1000, "enwiki" if i % 2 else "dewiki") for i in range(5)])
    assert [x.edit_count for x in rows(trending_signals(e, TP))] == [5]
    assert trending_signals(e, TP, keys=("wiki", "title")).count() == 0


def test_null_title_only_in_bot_branch(spark):
    e = make_edits(spark, [(None, True, i * 1000) for i in range(10)])
    assert trending_signals(e, TP).count() == 0
    assert [(x.bot_edit_count, x.total_edit_count) for x in rows(bot_anomaly_signals(e, BP))] == [(10, 10)]


def _bots(spark, n_bot, n_human):
    return make_edits(spark, [(f"T{i}", True, i * 1000) for i in range(n_bot)]
                      + [(f"H{i}", False, (n_bot + i) * 1000) for i in range(n_human)])


def test_ratio_equal_to_threshold_does_not_fire(spark):
    assert bot_anomaly_signals(_bots(spark, 8, 2), BP).count() == 0


def test_nine_of_ten(spark):
    r = rows(bot_anomaly_signals(_bots(spark, 9, 1), BP))
    assert [(x.bot_edit_count, x.total_edit_count, x.ratio, x.key) for x in r] == [(9, 10, 0.9, "global")]


def test_low_volume(spark):
    assert bot_anomaly_signals(_bots(spark, 5, 0), BP).count() == 0


def test_ten_of_twelve(spark):
    r = rows(bot_anomaly_signals(_bots(spark, 10, 2), BP))[0]
    assert (r.bot_edit_count, r.total_edit_count) == (10, 12)
    assert abs(r.ratio - 10 / 12) < 1e-12
    assert r.title is None and r.edit_count is None


def test_both_kinds(spark):
    e = make_edits(spark, [("Hot", True, i * 1000) for i in range(6)]
                   + [(f"B{i}", True, (6 + i) * 1000) for i in range(4)] + [("Hum", False, 11_000)])
    r = rows(detect_signals(e, TP, BP))
    assert [(x.signal_type, x.title, x.edit_count, x.bot_edit_count, x.total_edit_count) for x in r] == [
        ("BOT_ANOMALY", None, None, 10, 11), ("TRENDING", "Hot", 6, None, None)]


def test_neither(spark):
    e = make_edits(spark, [("Hum", False, i * 1000) for i in range(3)] + [(f"B{i}", True, 5000 + i) for i in range(2)])
    assert detect_signals(e, TP, BP).count() == 0


def test_bad_params():
    import pytest
    with pytest.raises(ValueError):
        TrendingParams(window=0)
    with pytest.raises(ValueError):
        BotParams(ratio_threshold=None)


def test_late_drop_needs_arrival(spark):
    import pytest
    e = make_edits(spark, [("A", False, 0)])
    with pytest.raises(ValueError):
        trending_signals(e, TP, late="drop")
    with pytest.raises(ValueError):
        trending_signals(e, TP, late="sometimes")


def test_branch_specific_arrival(spark):
    """Keyed branch with per-partition clocks, bot branch with one global clock."""
    from pyspark.sql import functions as F
    from edit_signals.params import Arrival
    # partition 1 sees window 1 first; partition 0's window-0 edits arrive after that
    rows = [("B", True, 6 * MIN, 0)] + [("A", True, i * 1000, 1000 + i) for i in range(10)]
    e = make_edits(spark, rows).withColumn("p", F.when(F.col("title") == "B", 1).otherwise(0))
    per_part = Arrival(partitions=("p",))
    out = detect_signals(e, TP, BotParams(min_volume=5), arrival=per_part, late="drop", bot_arrival=Arrival())
    kinds = sorted(r.signal_type for r in out.collect())
    assert kinds == ["TRENDING"]   # A's edits are on time for their partition, late for the global clock
