"""Session helpers: UTC time zone, adaptive execution, and a shared work folder.

Every public entry point calls :func:`prepare` so results never depend on the
caller's session time zone (windows, ``date_format`` and the NTZ casts all assume
UTC wall-clock time).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every entry point needs for correct results.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings that only affect speed; applied when the session has no value yet.
_TUNING = {
    # no Python call-site capture on every DataFrame call (error context only)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "edit_signals") -> SparkSession:
    """Local/test session. On a cluster use the session the platform provides."""
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**_REQUIRED, **_TUNING}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in _REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and landed intermediate tables.

    Taken from the session (``spark.checkpoint.dir`` / the context's checkpoint
    dir). Only when neither is set and the master is local - tests - a fresh temporary folder
    is registered as the checkpoint dir; on a cluster that is an error, since executors do
    not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext access (remote session)
        sc = None
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        master = "" if sc is None else sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="edit-signals-")
        if sc is not None:
            sc.setCheckpointDir(base)
    elif sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared work dir (never reused)."""
    return f"{work_dir(spark)}/edit_signals/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for os-level checks in local mode."""
    return path[5:] if path.startswith("file:") else path


def exists(path: str) -> bool:
    return os.path.exists(local_path(path))
