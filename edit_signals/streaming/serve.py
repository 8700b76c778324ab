"""Serving: signal records -> keyed store (last write wins) and the newest-N report.

Each micro-batch appends its decoded items to a store log (one folder per batch id,
idempotent on replay) and rewrites the small recent-signals snapshot: the previous
snapshot (<= N rows) plus this batch, newest N kept. Every ``compact_every`` batches
the log is folded into a compacted view, of which only the days it touches are written again, and the folded
folders are dropped, so the number of log folders stays bounded. The store's current view (``store_view``) is the
compacted view plus the newer log, reduced to the latest write per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_signals
from ..operators.report import recent_signals
from ..operators.store import ITEM_COLUMNS, latest_items, signal_items
from ..params import RECENT_SIGNALS
from ..sources.records import read_signal_records, with_file_position
from .common import (await_done, hadoop_path, latest_version, retain_versions, start, version_folder, version_is_committed,
                     write_batch_partition)


def arrived(signals: DataFrame) -> DataFrame:
    """Adds ``emitted``, the arrival order of signal records: record time, partition, offset, then, without an offset,
    the file and row a record was read from (null for other sources), then its text."""
    def known(c: str, kind: str):  # noqa: ANN202 - column
        return (F.col(c) if c in signals.columns else F.lit(None).cast(kind)).alias(c)

    position = "struct<time:timestamp,file:string,row:bigint>"
    if "offset" in signals.columns and "file_position" in signals.columns:
        signals = signals.withColumn("file_position", F.when(F.col("offset").isNull(), F.col("file_position")))
    return signals.withColumn("emitted", F.struct(
        known("record_ts", "timestamp"), known("partition", "int"), known("offset", "bigint"),
        known("file_position", position), known("value", "string")))


# Fold the store log into a compacted view every this many micro-batches.
COMPACT_EVERY = 100


def serve_batch(records: DataFrame, batch_id: int, store_log_path: str, recent_path: str,
                n: int = RECENT_SIGNALS, compact_every: int | None = COMPACT_EVERY) -> None:
    spark = records.sparkSession
    signals = arrived(decode_signals(records, "value")).persist()
    try:
        write_batch_partition(signal_items(signals, keep=["emitted"]), batch_id, store_log_path)
        cols = ["signal_type", "title", "edit_count", "bot_edit_count", "total_edit_count", "ratio",
                "window_start", "window_end", "emitted"]
        current = signals.select(*cols)
        prev_path = _latest_snapshot(spark, recent_path, before=batch_id)
        if prev_path is not None:
            current = spark.read.parquet(prev_path).select(*cols).unionByName(current)
        recent_signals(current, n).write.mode("overwrite").parquet(f"{recent_path}/snapshot={batch_id:012d}")
        _retain(spark, recent_path, "snapshot", keep_from=_versions(spark, recent_path, "snapshot", batch_id)[-1:])
    finally:
        signals.unpersist()
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact_store(spark, store_log_path, batch_id)


# ---- versioned folders (<name>=<id> with _SUCCESS) -----------------------------------

def _versions(spark: SparkSession, root: str, name: str, before: int, committed: bool = True) -> list[int]:
    """Ids of ``root/<name>=<id>`` folders below ``before``, ascending (metadata only).
    Old versions are removed as new ones commit, so the listing stays short."""
    jvm, path, fs = hadoop_path(spark, root)
    if not fs.exists(path):
        return []
    ids = []
    for st in fs.listStatus(path):
        folder = st.getPath().getName()
        if folder.startswith(f"{name}="):
            b = int(folder.split("=", 1)[1])
            if b < before and (not committed or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
                ids.append(b)
    return sorted(ids)


def _delete(spark: SparkSession, root: str, name: str, ids: list[int], width: int = 12) -> None:
    jvm, path, fs = hadoop_path(spark, root)
    for b in ids:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"{name}={b:0{width}d}" if width else f"{name}={b}"), True)


def _retain(spark: SparkSession, root: str, name: str, keep_from: list[int]) -> None:
    """Remove versions older than ``keep_from[0]`` (the newest two stay, so a reader never
    loses the committed version while the next one is written)."""
    if keep_from:
        _delete(spark, root, name, _versions(spark, root, name, before=keep_from[0], committed=False))


def _latest_snapshot(spark: SparkSession, recent_path: str, before: int) -> str | None:
    """Newest committed snapshot folder written by an earlier batch."""
    ids = _versions(spark, recent_path, "snapshot", before)
    return f"{recent_path}/snapshot={ids[-1]:012d}" if ids else None


# ---- store: log + compacted view ---------------------------------------------------------

_STORE_COLS = ITEM_COLUMNS + ["emitted"]


def _view_root(store_log_path: str) -> str:
    return f"{store_log_path.rstrip('/')}_view"


def _day(col: str = "windowEnd"):  # noqa: ANN202 - column
    """Day (UTC) a window ends on: what the compacted view is partitioned by."""
    return F.date_format(F.timestamp_millis(F.col(col)), "yyyy-MM-dd")


def _view_list(store_log_path: str) -> str:
    return f"{_view_root(store_log_path)}_live"


def _view_days(spark: SparkSession, store_log_path: str, version: int | None) -> dict[str, int]:
    """Day -> compaction that wrote it last: a row per day."""
    if version is None:
        return {}
    rows = spark.read.schema("day string, upto bigint").parquet(version_folder(_view_list(store_log_path), version))
    return {r["day"]: r["upto"] for r in rows.collect()}


def _day_folders(store_log_path: str, days: dict[str, int]) -> list[str]:
    return [f"{_view_root(store_log_path)}/upto={u:012d}/day={d}" for d, u in sorted(days.items())]


def _log_batches(spark: SparkSession, store_log_path: str, after: int, upto: int | None = None) -> list[int]:
    return [b for b in _versions(spark, store_log_path, "batch_id", 2 ** 62) if b > after and (upto is None or b <= upto)]


def _read_log(spark: SparkSession, store_log_path: str, batches: list[int]) -> DataFrame:
    """Log items of those batches (partition pruning)."""
    return spark.read.parquet(store_log_path).filter(F.col("batch_id").between(batches[0], batches[-1])).select(*_STORE_COLS)


def _store_items(spark: SparkSession, store_log_path: str) -> DataFrame | None:
    """Items of the compacted days plus log batches after the last compaction."""
    last = latest_version(spark, _view_list(store_log_path), 2 ** 62)
    folders = _day_folders(store_log_path, _view_days(spark, store_log_path, last))
    parts = [spark.read.parquet(*folders).select(*_STORE_COLS)] if folders else []
    batches = _log_batches(spark, store_log_path, -1 if last is None else last)
    if batches:
        parts.append(_read_log(spark, store_log_path, batches))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact_store(spark: SparkSession, store_log_path: str, upto: int) -> None:
    """Fold the log up to batch ``upto`` into the view: latest item per (pk, sk, title), so both key modes can still be
    derived. The view is kept by the day a window ends on, and only days the log touches are written again;
    all other days keep their files, so the cost follows the new items and not the store.

    Crash-safe: the touched days go to a folder of their own, then a list of (day, folder) is committed, and only then the
    folded log and the folders no list names any more are removed. What this compaction replaces goes with the next
    one, so a reader of the list before keeps its files."""
    root, listing = _view_root(store_log_path), _view_list(store_log_path)
    before = latest_version(spark, listing, upto)
    if not version_is_committed(spark, listing, upto):
        days = _view_days(spark, store_log_path, before)
        batches = _log_batches(spark, store_log_path, -1 if before is None else before, upto)
        if not batches:
            return
        items = _read_log(spark, store_log_path, batches).withColumn("day", _day())
        touched = [r["day"] for r in items.select("day").distinct().collect()]  # days, not items
        old = _day_folders(store_log_path, {d: u for d, u in days.items() if d in touched})
        if old:
            items = items.unionByName(spark.read.parquet(*old).select(*_STORE_COLS).withColumn("day", _day()))
        folded = latest_items(items, "window_title", keep=["emitted"]).withColumn("day", _day())
        # a day goes to as many tasks as its items need, and not to one file from every task
        folded.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{root}/upto={upto:012d}")
        days |= {d: upto for d in touched}
        spark.createDataFrame(sorted(days.items()), "day string, upto bigint").coalesce(1).write.mode("overwrite").parquet(
            version_folder(listing, upto))
    _delete(spark, store_log_path, "batch_id",
            [b for b in _versions(spark, store_log_path, "batch_id", 2 ** 62, committed=False) if b <= upto], width=0)
    retain_versions(spark, listing, upto)
    named = set(_day_folders(store_log_path, _view_days(spark, store_log_path, upto)))
    named |= set(_day_folders(store_log_path, _view_days(spark, store_log_path, before)))
    _drop_unnamed_days(spark, root, upto, named)


def _drop_unnamed_days(spark: SparkSession, root: str, upto: int, named: set[str]) -> None:
    """Remove day folders of earlier compactions that neither of the last two lists names."""
    names = {"/".join(f.split("/")[-2:]) for f in named}
    jvm, path, fs = hadoop_path(spark, root)
    for version in (st.getPath() for st in fs.listStatus(path)):
        if int(version.getName().split("=", 1)[1]) < upto:
            left = 0
            for st in fs.listStatus(version):
                name = f"{version.getName()}/{st.getPath().getName()}"
                if st.isDirectory() and name not in names:
                    fs.delete(st.getPath(), True)
                left += st.isDirectory() and name in names
            if not left:
                fs.delete(version, True)


def start_serving(spark: SparkSession, signals_path: str, store_log_path: str, recent_path: str,
                  checkpoint: str, source_format: str = "parquet", trigger: dict | None = None,
                  n: int = RECENT_SIGNALS, name: str | None = None, compact_every: int | None = COMPACT_EVERY,
                  **source_options):
    records = with_file_position(
        read_signal_records(spark, signals_path, fmt=source_format, streaming=True, **source_options), source_format)
    writer = (records.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: serve_batch(df, bid, store_log_path, recent_path, n, compact_every)))
    if name:
        writer = writer.queryName(name)
    return start(writer, trigger)


def run_serving(spark: SparkSession, *args, timeout_s: float | None = None, **kwargs):
    return await_done(start_serving(spark, *args, **kwargs), timeout_s)


def store_view(spark: SparkSession, store_log_path: str, key: str = "window") -> DataFrame:
    """Current store contents: the latest write per key over the compacted view and the
    log written after it."""
    if key not in ("window", "window_title"):
        raise ValueError(f"unknown store key mode {key!r}")
    items = _store_items(spark, store_log_path)
    if items is None:
        return spark.createDataFrame([], signal_items_schema())
    return latest_items(items, key)


def signal_items_schema() -> str:
    return ("pk string, sk string, signalType string, windowStart bigint, windowEnd bigint, title string, "
            "editCount bigint, botEditCount bigint, totalEditCount bigint, ratio double")


def recent_view(spark: SparkSession, recent_path: str) -> DataFrame | None:
    latest = _latest_snapshot(spark, recent_path, before=2 ** 62)
    return None if latest is None else spark.read.parquet(latest)


__all__ = ["arrived", "serve_batch", "start_serving", "run_serving", "store_view", "recent_view", "compact_store"]
