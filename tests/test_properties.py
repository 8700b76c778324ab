"""Property test: exact lateness and revisions equal a record-at-a-time replay of the
reference's semantics, for arbitrary arrival disorder."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from edit_signals.operators import bot_revisions, flag_late, trending_revisions
from edit_signals.params import Arrival, BotParams, TrendingParams

from .conftest import make_edits

MIN = 60_000

edit = st.tuples(st.sampled_from(["A", "B"]), st.booleans(), st.integers(0, 20 * MIN))
arrivals = st.lists(edit, min_size=1, max_size=60)


def replay(rows, width_ms, threshold, ratio, volume):
    """Record at a time: stream time, zero-grace drop, per-window state, emit on update."""
    hw, counts, bots, late, trend, bot = -1, {}, {}, [], [], []
    for i, (title, is_bot, ev) in enumerate(rows):
        hw = max(hw, ev)
        w = ev // width_ms
        if (w + 1) * width_ms <= hw:
            late.append(True)
            continue
        late.append(False)
        counts[(title, w)] = counts.get((title, w), 0) + 1
        if counts[(title, w)] >= threshold:
            trend.append((i, title, counts[(title, w)]))
        t, b = bots.get(w, (0, 0))
        bots[w] = (t + 1, b + is_bot)
        if t + 1 >= volume and (b + is_bot) / (t + 1) > ratio:
            bot.append((i, t + 1, b + is_bot))
    return late, trend, bot


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=arrivals)
def test_lateness_and_revisions_match_replay(spark, rows):
    tp, bp = TrendingParams(window=5, threshold=3), BotParams(window=5, ratio_threshold=0.5, min_volume=4)
    data = [(t, b, ev, i * 1000) for i, (t, b, ev) in enumerate(rows)]   # arrival order = list order
    e = make_edits(spark, data, bucket_ms=3000)
    late, trend, bot = replay(rows, 5 * MIN, 3, 0.5, 4)
    assert [r.late for r in flag_late(e, 5, fanout=2)
            .orderBy("arrival_id").collect()] == late
    got_t = sorted((r.emitted.arrival_id, r.title, r.edit_count) for r in trending_revisions(e, tp, Arrival()).collect())
    assert got_t == sorted(trend)
    got_b = sorted((r.emitted.arrival_id, r.total_edit_count, r.bot_edit_count)
                   for r in bot_revisions(e, bp, Arrival()).collect())
    assert got_b == sorted(bot)
