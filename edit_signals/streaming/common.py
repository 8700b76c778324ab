"""Shared pieces of the streaming queries."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Session settings taken by a stateful detection query when it starts.
DETECTION_CONFS = {
    # judge lateness against the current watermark (see the lateness note in the README)
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
}


@contextlib.contextmanager
def session_confs(spark: SparkSession, confs: dict[str, str]):
    """Apply ``confs`` while a query starts (a query copies the session conf at start)."""
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_confs(state_store: str | None) -> dict[str, str]:
    """RocksDB keeps large keyed state off the JVM heap; changelog checkpointing uploads
    only the changes of each micro-batch instead of a snapshot of every store."""
    if state_store == "rocksdb":
        return {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    return {}


def start(writer, trigger: dict | None) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return writer.trigger(**trigger).start()


def await_done(q: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query; re-raise its failure."""
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"streaming query {q.name or q.id} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(f"streaming query failed: {q.exception()}")
    return q


def hadoop_path(spark: SparkSession, path: str):
    """(JVM, Hadoop path, its file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the micro-batch's folder was written completely."""
    _, marker, fs = hadoop_path(spark, f"{batch_folder(path, batch_id)}/_SUCCESS")
    return fs.exists(marker)


def write_batch_partition(df: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Micro-batch write into the partition folder ``batch_id=<id>`` (read back through
    partition discovery). A replayed batch that was committed is left alone, so its files keep
    their names and a file-stream reader that took them does not see them again; one that was
    cut short is overwritten."""
    if not is_committed(df.sparkSession, path, batch_id):
        df.write.mode("overwrite").format(fmt).save(batch_folder(path, batch_id))


# ---- versioned folders (version=<batch id>, complete once it has its marker) -----------------

def version_folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version:012d}"


def version_is_committed(spark: SparkSession, root: str, version: int) -> bool:
    _, marker, fs = hadoop_path(spark, f"{version_folder(root, version)}/_SUCCESS")
    return fs.exists(marker)


def versions(spark: SparkSession, root: str, below: int, committed: bool = True) -> list[int]:
    """Versions below a batch id, ascending (metadata only; old ones are removed, so the listing is short)."""
    jvm, path, fs = hadoop_path(spark, root)
    if not fs.exists(path):
        return []
    found = [int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(path)
             if st.getPath().getName().startswith("version=")]
    return sorted(v for v in found if v < below and (not committed or version_is_committed(spark, root, v)))


def latest_version(spark: SparkSession, root: str, below: int) -> int | None:
    return next(reversed(versions(spark, root, below)), None)


def retain_versions(spark: SparkSession, root: str, current: int) -> None:
    """Remove what is older than the version before ``current``."""
    jvm, _, fs = hadoop_path(spark, root)
    older = versions(spark, root, current, committed=False)[:-1]
    for v in older:
        fs.delete(jvm.org.apache.hadoop.fs.Path(version_folder(root, v)), True)
