"""Emit-on-every-update revisions and first crossings, exact in batch.

Without suppression each accepted record updates its window and every update that
passes the predicate is a signal. The state after record r is the running total of
its group over records that arrived at or before r.

Scale: a group can be huge (the bot branch groups by window only; one window may hold a
third of all events). Running totals are therefore computed in two parts:

1. per (group, arrival bucket) totals - a partial aggregate - then an exclusive prefix
   over buckets inside the group (a window over the small bucket table);
2. running totals inside each (group, bucket) - a window partitioned by the bucket too,
   so a hot group is spread over its buckets (the bucket prefix itself is a two-level
   scan over blocks of buckets, so many buckets per group are fine too);

and the two are added after an equi-join on (group, bucket). The join comes before the row-level
window and keeps only the buckets a signal can come from, by their totals: of a trending window those that
end at or above the threshold, of a bot window those that end above the volume and whose ratio would pass if
all their bots came first. Titles that never trend and quiet buckets cost one aggregate and no sort.

With one clock for all records (:func:`_two_scans`) lateness comes from the same bucket table: it also holds
every bucket's first arrival, from which follow the first arrival per pane and the arrival that
closes a window. Buckets after that one are late whole, the ones before it are not, and only in the
closing bucket rows are looked at. So the input is scanned twice: once for the table, once for the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import BOT_ANOMALY, GLOBAL_KEY, TRENDING, Arrival, BotParams, TrendingParams, window_micros
from .arrival import arrival_key
from .filters import drop_null_keys
from .lateness import apply_late, closing_arrivals, pane_micros, pane_start
from .signals import bot_anomaly_filter, bots_dominate, to_bot_signal, to_trending_signal, trending_filter, trends
from .windows import bot_ratio, is_bot, tumbling


# Buckets per block of the second scan level.
FANOUT = 1024


def _block(bucket: Column, fanout: int) -> Column:
    """``floor(bucket / fanout)`` without a detour over doubles."""
    return F.call_function("div", bucket - F.pmod(bucket, F.lit(fanout)), F.lit(fanout))


def _bucket_prefix(per_bucket: DataFrame, group_cols: Sequence[str], b: str, names: list[str],
                   levels: int, fanout: int) -> DataFrame:
    """Per (group, bucket): its sums ``_s_<n>`` and those of the group's earlier buckets, ``_b_<n>``.

    One level is a window over the group's buckets. With more levels the buckets are cut
    into blocks of ``fanout``: a window inside each (group, block) plus the prefix over
    earlier blocks (recursively), so even a group with 10^9 buckets keeps every task small.
    """
    if levels <= 1:
        before = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        return per_bucket.select(*group_cols, b, *[f"_s_{n}" for n in names], *[
            F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    blk = f"_blk{levels}"
    pb = per_bucket.withColumn(blk, _block(F.col(b), fanout))
    per_block = pb.groupBy(*group_cols, blk).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names])
    block_base = _bucket_prefix(per_block, group_cols, blk, names, levels - 1, fanout)
    within = Window.partitionBy(*group_cols, blk).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    local = pb.select(*group_cols, b, blk, *[f"_s_{n}" for n in names], *[
        F.coalesce(F.sum(f"_s_{n}").over(within), F.lit(0)).alias(f"_l_{n}") for n in names])
    return (local.join(block_base.drop(*[f"_s_{n}" for n in names]), [*group_cols, blk], "inner")
            .select(*group_cols, b, *[f"_s_{n}" for n in names], *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(f"_b_{n}") for n in names]))


def running_totals(df: DataFrame, group_cols: Sequence[str], arrival: Arrival, measures: dict[str, Column],
                   levels: int = 2, fanout: int = FANOUT,
                   reach: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """For every row, the sums of ``measures`` over the rows of its group that arrived
    at or before it (arrival order ``arrival.order``; ``arrival.bucket`` must be
    non-decreasing along it).

    ``reach(before, after)`` prunes: given the totals of a measure before and after a bucket, it
    says whether a row of the bucket can matter. Other buckets leave in the join, before
    the row-level window, so rows of groups that never get there are not sorted."""
    b = arrival.bucket
    names = list(measures)
    src = df.withColumns({f"_m_{n}": m.cast("bigint") for n, m in measures.items()})

    per_bucket = src.groupBy(*group_cols, b).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    base = _bucket_prefix(per_bucket, list(group_cols), b, names, levels, fanout)
    if reach is not None:
        base = base.filter(reach(lambda n: F.col(f"_b_{n}"), lambda n: F.col(f"_b_{n}") + F.col(f"_s_{n}")))
    base = base.drop(*[f"_s_{n}" for n in names])
    return _row_totals(src.join(base, [*group_cols, b], "inner"), group_cols, arrival, names)


def _row_totals(rows: DataFrame, group_cols: Sequence[str], arrival: Arrival, names: Sequence[str]) -> DataFrame:
    """Rows with their measures ``_m_<n>`` and the totals before their bucket ``_b_<n>``: totals up to each row."""
    upto = (Window.partitionBy(*group_cols, arrival.bucket).orderBy(*[F.col(c) for c in arrival.order])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumns({n: F.col(f"_b_{n}") + F.sum(f"_m_{n}").over(upto) for n in names})
            .drop(*[f"_{p}_{n}" for p in "mb" for n in names]))


def _emitted(arrival: Arrival) -> Column:
    return F.struct(*[F.col(c) for c in arrival.emitted_columns]).alias("emitted")


def _one_clock(arrival: Arrival) -> None:
    if arrival.partitions:
        raise ValueError("bot windows span the input partitions: their arrival order needs one clock")


def _with_prefix(per_bucket: DataFrame, group: Sequence[str], bucket: str, names: Sequence[str], fanout: int,
                 carried: DataFrame | None = None) -> DataFrame:
    """One row per (group, block of ``fanout`` buckets): ``_buckets``, an array of the block's buckets in order with
    their sums ``_s_<n>`` and the sums of all earlier buckets of the group ``_b_<n>``, and the other columns of
    ``per_bucket``, which must be the same for a whole group.

    ``carried`` has the totals ``<n>`` a group starts from. A linear pipeline (no self-join): sums are folded along the array, a window over a group's blocks adds what comes before."""
    sums = [f"_s_{n}" for n in names]
    rest = [c for c in per_bucket.columns if c not in (*group, bucket, *sums)]
    blocks = per_bucket.groupBy(*group, _block(F.col(bucket), fanout).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct(bucket, *sums))).alias("_buckets"), *[F.sum(c).alias(f"_t{c}") for c in sums],
        *[F.min(c).alias(c) for c in rest])
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_t_s_{n}").over(earlier), F.lit(0)) for n in names})
    if carried is not None:
        start = carried.select(*group, *[F.col(n).alias(f"_0{n}") for n in names])
        blocks = blocks.join(start, list(group), "left").withColumns(
            {f"_b_{n}": F.col(f"_b_{n}") + F.coalesce(f"_0{n}", F.lit(0)) for n in names})
    kind = per_bucket.schema[bucket].dataType.simpleString()
    entry = ",".join([f"{bucket}:{kind}", *[f"{c}:bigint" for c in sums], *[f"_b_{n}:bigint" for n in names]])

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x[bucket].alias(bucket), *[x[c].alias(c) for c in sums], *[acc[f"_b_{n}"].alias(f"_b_{n}") for n in names])
        return F.struct(*[(acc[f"_b_{n}"] + x[f"_s_{n}"]).alias(f"_b_{n}") for n in names],
                        F.concat(acc["done"], F.array(here)).alias("done"))

    start = F.struct(*[F.col(f"_b_{n}").alias(f"_b_{n}") for n in names], F.array().cast(f"array<struct<{entry}>>").alias("done"))
    return blocks.select(*group, "_block", *rest, F.aggregate("_buckets", start, step, lambda acc: acc["done"]).alias("_buckets"))


# Buckets per block of that fold.
FOLD = 256


def group_columns(arrival: Arrival, keys: Sequence[str] = ("title",)) -> list[str]:
    """What a running total belongs to: detector, window start, clock scope and keys (never null)."""
    return ["signal_type", "_ws", *arrival.partitions, *[f"_g_{k}" for k in keys]]


def _two_scans(edits: DataFrame, trending: TrendingParams | None, bot: BotParams | None, arrival: Arrival, late: str,
               keys: Sequence[str] = ("title",), first: bool = False, fanout: int = FOLD, carried: DataFrame | None = None,
               mark: str | None = None) -> DataFrame:
    """Revisions of one or both detectors from two scans of the edits (an order that packs into one key).

    ``first``: work only on the buckets in which a window can cross first. ``carried`` has the totals ``_n`` and ``_nb``
    that earlier records left per group (``group_columns``), ``mark`` is the column of the highest time (epoch
    microseconds) seen before these edits: with both, the edits may be a part of a longer arrival order."""
    b = arrival.bucket
    both = [p for p in (trending, bot) if p is not None]
    pane_us = pane_micros(*[p.window for p in both])
    scope = list(arrival.partitions)
    carry = ["bot", *dict.fromkeys((*arrival.order, *arrival.emitted_columns, *scope, b, *([mark] if mark else [])))]
    clock = BOT_ANOMALY if bot is not None else TRENDING  # the branch that tells the first arrivals: all rows are in it
    finer = late == "drop" and window_micros(both[-1].window) != pane_us

    def tagged(kind: str, params, key_of) -> Column:  # noqa: ANN001 - a row of one detector's branch
        pane = [pane_start(pane_us if kind == clock else window_micros(params.window)).alias("_pane")] if finer else []
        return F.struct(F.lit(kind).alias("signal_type"), pane_start(window_micros(params.window)).alias("_ws"),
                        *pane, *[key_of(k).alias(k) for k in keys], *[F.col(c) for c in carry])

    branches = [] if trending is None else [tagged(TRENDING, trending, F.col)]
    if bot is not None:
        branches.append(tagged(BOT_ANOMALY, bot, lambda k: F.lit(None).cast("string")))
    # known for a single detector: a condition on its constant type would filter one use of the bucket table
    is_tr = F.col("signal_type") == TRENDING if len(both) == 2 else F.lit(trending is not None)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    rows = edits.filter(F.col("event_time").isNotNull()).select(F.explode(F.array(*branches)).alias("_r")).select("_r.*")
    rows = rows.withColumns({"_m__n": F.lit(1).cast("bigint"), "_m__nb": is_bot().cast("bigint"),
                             **{f"_g_{k}": F.coalesce(F.col(k), F.lit("")) for k in keys}})  # no null in an equi-join key
    rows = rows.filter("_ws IS NOT NULL")
    width = F.lit(window_micros(both[0].window)) if len(both) == 1 else F.when(
        is_tr, F.lit(window_micros(trending.window))).otherwise(F.lit(window_micros(bot.window)))
    if mark:  # windows that were closed before; their rows move no clock that was not past them
        rows = rows.filter(F.col(mark).isNull() | (F.col("_ws") + width > F.col(mark))).drop(mark)
    group = group_columns(arrival, keys)

    # first scan: totals and first arrival per (group, bucket), finer by pane where windows are wider
    table = rows.withColumn("_keyed", ~is_tr | keyed)
    panes = ["_pane"] if finer else []
    table = table.groupBy(*group, "_keyed", *panes, b).agg(
        F.sum("_m__n").alias("_s__n"), F.sum("_m__nb").alias("_s__nb"), F.min(arrival_key(rows, arrival)).alias("_first"))
    closed = []
    if late == "drop":
        # Both uses of the table share one exchange: each needs all its columns (the condition always holds), and
        # conditions on its keys are worded so that they are not pushed below it in one use only.
        table = table.filter("_s__n >= _s__nb AND (_first IS NOT NULL OR _keyed OR _s__n > 0)")
        firsts = table.groupBy(*scope, F.col("_pane" if finer else "_ws").alias("_pane")).agg(
            F.min(F.when(is_tr == F.lit(clock == TRENDING), F.col("_first"))).alias("_first")).filter("_first IS NOT NULL")
        names = {f"_c{i}": window_micros(p.window) for i, p in enumerate(both)}
        closing = closing_arrivals(firsts, pane_us, names, tuple(scope), fanout=FANOUT)
        # per window and detector, from its last pane
        closing = closing.select(*scope, F.explode(F.array(*[
            F.struct(F.lit(TRENDING if p is trending else BOT_ANOMALY).alias("signal_type"),
                     (F.col("_pane") - F.pmod("_pane", F.lit(us))).alias("_ws"), F.col(n).alias("_closed"))
            for p, (n, us) in zip(both, names.items())])).alias("_w")).select(*scope, "_w.*").distinct()
        on = [*scope, "signal_type", "_ws"] if len(both) == 2 else [*scope, "_ws"]  # a constant key would filter one use of the table
        closing = closing.select(*on, "_closed")
        # a bucket that begins at or after the closing arrival is late whole
        table = table.join(closing, on).filter(F.col("_closed").isNull() | (F.col("_first") < F.col("_closed")))
        closed = ["_closed"]
    per_bucket = table.filter("CASE WHEN _keyed THEN _s__n ELSE 0 END > 0").select(*group, b, "_s__n", "_s__nb", *closed)
    if finer:
        per_bucket = per_bucket.groupBy(*group, b, *closed).agg(F.sum("_s__n").alias("_s__n"), F.sum("_s__nb").alias("_s__nb"))

    # totals of the closing bucket count its late rows too: bounds from above, and no bucket comes after it
    blocks = _with_prefix(per_bucket, group, b, ["_n", "_nb"], fanout, carried)

    def reach(x: Column) -> Column:
        before_n, after_n, after_nb = x["_b__n"], x["_b__n"] + x["_s__n"], x["_b__nb"] + x["_s__nb"]
        found = F.lit(False)
        if trending is not None:
            up = trends(after_n, trending.threshold)
            found = found | (is_tr & (up & ~trends(before_n, trending.threshold) if first else up))
        if bot is not None:
            best = bot_ratio(after_nb, before_n + x["_s__nb"])  # all bots of the bucket before its first human
            found = found | (~is_tr & (after_n >= bot.min_volume) & (best > F.lit(float(bot.ratio_threshold))))
        return found

    if first and bot is not None:
        # a bucket that ends in a passing state holds a crossing: later ones do not matter
        over = F.array_min(F.transform(F.filter("_buckets", lambda x: bots_dominate(
            x["_b__n"] + x["_s__n"], bot_ratio(x["_b__nb"] + x["_s__nb"], x["_b__n"] + x["_s__n"]), bot.ratio_threshold,
            bot.min_volume)), lambda x: x[b]))
        blocks = blocks.withColumn("_over", F.min(over).over(Window.partitionBy(*group)))
        wanted = F.filter("_buckets", lambda x: reach(x) & (is_tr | F.col("_over").isNull() | (x[b] <= F.col("_over"))))
    else:
        wanted = F.filter("_buckets", reach)
    base = blocks.select(*group, *closed, F.explode(wanted).alias("_x")).select(
        *group, *closed, f"_x.{b}", "_x._b__n", "_x._b__nb")

    # second scan: the rows of those buckets
    src = rows.filter(~is_tr | keyed).drop(*panes).join(base, [*group, b])
    if closed:
        src = src.filter(F.col("_closed").isNull() | (arrival_key(src, arrival) < F.col("_closed")))
    counted = _row_totals(src, group, arrival, ["_n", "_nb"])
    ratio = bot_ratio(F.col("_nb"), F.col("_n"))
    keep = F.lit(False)
    if trending is not None:
        keep = is_tr & trends(F.col("_n"), trending.threshold)
    if bot is not None:
        keep = keep | (~is_tr & bots_dominate(F.col("_n"), ratio, bot.ratio_threshold, bot.min_volume))
    title = F.col("title") if "title" in keys else F.lit(None).cast("string")
    return counted.filter(keep).select(
        "signal_type", title.alias("title"),
        F.when(is_tr, F.col("_n")).alias("edit_count"),
        F.when(~is_tr, F.col("_nb")).alias("bot_edit_count"),
        F.when(~is_tr, F.col("_n")).alias("total_edit_count"),
        F.when(~is_tr, ratio).alias("ratio"),
        F.timestamp_micros("_ws").alias("window_start"), F.timestamp_micros(F.col("_ws") + width).alias("window_end"),
        F.when(is_tr, title).otherwise(F.lit(GLOBAL_KEY)).alias("key"),
        *[k for k in keys if k != "title"],
        _emitted(arrival))


def _one_pipeline(edits: DataFrame, arrival: Arrival, late: str) -> bool:
    """Whether the two-scan form holds: one clock, an order that packs into one key."""
    if late not in ("keep", "drop"):
        raise ValueError(f"late must be 'keep' or 'drop', got {late!r}")
    if late == "drop" and arrival.order[0] == "event_time":
        raise ValueError(f"arrival order {arrival.order} starts with the event time: nothing could be late")
    return not arrival.partitions and arrival_key(edits, arrival) is not None


def trending_revisions(edits: DataFrame, params: TrendingParams = TrendingParams(), arrival: Arrival = Arrival(),
                       keys: Sequence[str] = ("title",), late: str = "drop") -> DataFrame:
    """One signal row per accepted record whose window count reaches the threshold.
    ``emitted`` = arrival of that record."""
    if _one_pipeline(edits, arrival, late):
        return _two_scans(edits, params, None, arrival, late, keys)
    src = tumbling(drop_null_keys(apply_late(edits, params.window, arrival, late), keys), params.window)
    counted = running_totals(src, ["window_start", "window_end", *keys], arrival, {"edit_count": F.lit(1)},
                             reach=lambda before, after: trends(after("edit_count"), params.threshold))
    counted = counted.select(*keys, "window_start", "window_end", "edit_count", _emitted(arrival))
    return to_trending_signal(trending_filter(counted, params.threshold),
                              [k for k in keys if k != "title"] + ["emitted"])


def bot_revisions(edits: DataFrame, params: BotParams = BotParams(), arrival: Arrival = Arrival(),
                  late: str = "drop") -> DataFrame:
    """One signal row per accepted record after which its window passes volume and ratio."""
    _one_clock(arrival)
    if _one_pipeline(edits, arrival, late):
        return _two_scans(edits, None, params, arrival, late)
    src = tumbling(apply_late(edits, params.window, arrival, late), params.window)

    def reach(before, after):  # noqa: ANN001, ANN202 - totals by measure name
        bots, humans = after("bot_edit_count"), before("total_edit_count") - before("bot_edit_count")
        return (after("total_edit_count") >= params.min_volume) & (
            bot_ratio(bots, bots + humans) > F.lit(float(params.ratio_threshold)))

    counted = running_totals(src, ["window_start", "window_end"], arrival,
                             {"total_edit_count": F.lit(1), "bot_edit_count": is_bot().cast("int")}, reach=reach)
    counted = counted.select(
        "window_start", "window_end", "total_edit_count", "bot_edit_count",
        bot_ratio(F.col("bot_edit_count"), F.col("total_edit_count")).alias("ratio"),
        _emitted(arrival))
    return to_bot_signal(bot_anomaly_filter(counted, params.ratio_threshold, params.min_volume), ["emitted"])


def signal_revisions(edits: DataFrame, trending: TrendingParams = TrendingParams(), bot: BotParams = BotParams(),
                     arrival: Arrival = Arrival(), late: str = "drop", bot_arrival: Arrival | None = None,
                     first: bool = False) -> DataFrame:
    """Revisions of both detectors (UNION ALL); ``bot_arrival`` as in ``detect_signals``.

    With one arrival order both detectors run as one pipeline over two scans: every row is
    tagged into its trending and its bot window, and one running-totals pass covers both.
    ``first=True`` is for :func:`first_crossing`: only the buckets in which a window can cross
    first are worked on, later revisions may be missing."""
    if bot_arrival is not None and bot_arrival != arrival:
        if arrival.emitted_columns != bot_arrival.emitted_columns:
            raise ValueError("both branches need the same emitted columns, or their signals cannot be ordered")
    elif _one_pipeline(edits, arrival, late):
        return _two_scans(edits, trending, bot, arrival, late, first=first)
    bot_arrival = bot_arrival or arrival
    _one_clock(bot_arrival)
    return trending_revisions(edits, trending, arrival, late=late).unionByName(
        bot_revisions(edits, bot, bot_arrival, late=late), allowMissingColumns=True)


def first_crossing(revisions: DataFrame) -> DataFrame:
    """Earliest revision (by ``emitted``) of each (signal type, window, title): when the alert is first raised.
    Every column is taken with ``min_by`` on the packed arrival key: a hash aggregate
    with a partial step, so a busy window is reduced before the exchange."""
    groups = ("signal_type", "window_start", "window_end", "title")
    parts = revisions.schema["emitted"].dataType.names
    flat = revisions.select("*", *[F.col(f"emitted.{c}").alias(f"_em_{c}") for c in parts])
    key = arrival_key(flat, Arrival(order=tuple(f"_em_{c}" for c in parts)))
    if key is None:
        key = F.col("emitted")
    value_cols = [c for c in revisions.columns if c not in groups and c != "emitted"]
    em_cols = [f"_em_{c}" for c in parts]
    out = flat.groupBy(*groups).agg(*[F.min_by(F.col(c), key).alias(c) for c in value_cols + em_cols])
    return out.select("signal_type", "title", *value_cols, "window_start", "window_end",
                      F.struct(*[F.col(f"_em_{c}").alias(c) for c in parts]).alias("emitted"))
