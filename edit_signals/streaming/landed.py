"""Landed topics with a list of live folders: compaction and readers without listing.

An ingest lands one folder per micro-batch. Beside them, ``<root>_live`` holds the list of the folders that make up the
topic, one small table per version; a version counts once it is complete, so the list is swapped in one
step. Every micro-batch appends its folder to the list; compaction replaces ``fan`` neighbouring folders of one level
by one folder of the next, so a topic of n micro-batches has at most ``fan`` folders per level and log(n) levels.
Replaced folders stay until the next compaction, for readers that took the list before.

A reader takes the newest list and reads exactly its folders. :func:`consume_landed` reads on from the position it
committed last: records keep their batch id through compaction, so every record is seen once, whether or not its folder
was compacted in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_folder, hadoop_path, latest_version, retain_versions, version_folder, version_is_committed

FAN = 10
_LIST = "folder string, first bigint, last bigint, level int"


def list_path(root: str) -> str:
    return f"{root.rstrip('/')}_live"


def compacted_path(root: str) -> str:
    return f"{root.rstrip('/')}_compacted"


def live_folders(spark: SparkSession, root: str) -> list[tuple[str, int, int, int]]:
    """(folder, first batch, last batch, level) of the topic, in order. Bounded: ``fan`` per level."""
    last = latest_version(spark, list_path(root), 2 ** 62)
    if last is None:
        return []
    rows = spark.read.schema(_LIST).parquet(version_folder(list_path(root), last)).collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def _swap(spark: SparkSession, root: str, version: int, folders: list[tuple[str, int, int, int]]) -> None:
    spark.createDataFrame(folders, _LIST).coalesce(1).write.mode("overwrite").parquet(version_folder(list_path(root), version))
    retain_versions(spark, list_path(root), version)


def commit_batch(spark: SparkSession, root: str, batch_id: int) -> None:
    """Append the folder of a complete micro-batch to the list; nothing happens if it is there already."""
    folders = live_folders(spark, root)
    if not any(first <= batch_id <= last for _, first, last, _ in folders):
        _swap(spark, root, 2 * batch_id, [*folders, (batch_folder(root, batch_id), batch_id, batch_id, 0)])


def _read_folders(spark: SparkSession, folders: list[tuple[str, int, int, int]], schema: T.StructType) -> DataFrame:
    """Records of folders with their ``batch_id``: the folder's own, or a column of a compacted one."""
    parts = []
    for level in (False, True):
        paths = [f for f, _, _, lv in folders if (lv > 0) == level]
        if paths:
            wide = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
            reader = spark.read.schema(wide)
            if not level:  # folders of micro-batches: the id is in their name
                reader = reader.option("basePath", paths[0].rsplit("/", 1)[0])
            parts.append(reader.parquet(*paths).select(*schema.names, F.col("batch_id").cast("bigint").alias("batch_id")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_landed(spark: SparkSession, root: str, schema: T.StructType, after: int | None = None,
                upto: int | None = None) -> DataFrame:
    """Records of a landed topic (of the batches after ``after``, up to ``upto``). Only folders that hold such batches are read."""
    low, high = (-1 if after is None else after), (2 ** 62 if upto is None else upto)
    wanted = [f for f in live_folders(spark, root) if f[2] > low and f[1] <= high]
    return _read_folders(spark, wanted, schema).filter(F.col("batch_id").between(low + 1, high))


def compact_landed(spark: SparkSession, root: str, schema: T.StructType, fan: int = FAN, order: tuple[str, ...] = ()) -> int:
    """Replace every ``fan`` neighbouring folders of one level by one of the next; returns how many were replaced.

    ``order`` sorts records inside a compacted file. Folders the list before the last one no longer names are removed."""
    if fan < 2:
        raise ValueError("fan must be 2 or more")
    folders, replaced = live_folders(spark, root), 0
    level = 0
    while any(f[3] >= level for f in folders):
        run = [f for f in folders if f[3] == level]
        for at in range(0, len(run) - fan + 1, fan):
            part = run[at:at + fan]
            first, last = part[0][1], part[-1][2]
            target = f"{compacted_path(root)}/level={level + 1}-batches={first:012d}-{last:012d}"
            rows = _read_folders(spark, part, schema)
            if order:
                rows = rows.sortWithinPartitions("batch_id", *order)
            # about as many files as the folders' data needs: Spark packs small files into one task
            rows.write.mode("overwrite").parquet(target)
            folders = sorted([f for f in folders if f not in part] + [(target, first, last, level + 1)], key=lambda r: r[1])
            replaced += fan
        level += 1
    if replaced:
        _remove_dropped(spark, root, folders)
        _swap(spark, root, 2 * folders[-1][2] + 1, folders)
    return replaced


def _remove_dropped(spark: SparkSession, root: str, new: list[tuple[str, int, int, int]]) -> None:
    """Remove what the current list does not name: it was replaced by an earlier compaction, before readers of
    this list began. Folders of micro-batches not committed yet are above the list's last batch."""
    current = live_folders(spark, root)
    top = max((f[2] for f in current), default=-1)
    named = {f[0].rsplit("/", 1)[-1] for f in [*current, *new]}
    for base in (root, compacted_path(root)):
        jvm, path, fs = hadoop_path(spark, base)
        if not fs.exists(path):
            continue
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            batch = int(name.split("=", 1)[1]) if name.startswith("batch_id=") else None
            if name not in named and (name.startswith("level=") or (batch is not None and batch <= top)):
                fs.delete(st.getPath(), True)


def consume_landed(spark: SparkSession, root: str, schema: T.StructType, position_path: str,
                   process: Callable[[DataFrame, int], None], batches: int | None = None) -> int | None:
    """Give the records after the committed position to ``process(records, last batch id)``, then commit that id. A call
    that was cut short gives the same first batch again, so ``process`` must be idempotent per id, as the sinks here
    are. ``batches`` bounds how many micro-batches one call takes. Returns the id, None if there is nothing new."""
    after = latest_version(spark, position_path, 2 ** 62)
    done = -1 if after is None else after
    known = [b for _, first, last, _ in live_folders(spark, root) for b in (first, last) if b > done]
    if not known:
        return None
    last = max(known) if batches is None else min(max(known), done + batches)
    process(read_landed(spark, root, schema, after, last), last)
    if not version_is_committed(spark, position_path, last):
        spark.createDataFrame([(last,)], "batch_id bigint").coalesce(1).write.mode("overwrite").parquet(
            version_folder(position_path, last))
    retain_versions(spark, position_path, last)
    return last
