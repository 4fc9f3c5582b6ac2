"""Session helper and the shared work folder.

A cluster names its shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only create our own folder when it is unset
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # call-site capture costs several JVM round trips per Column function
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Only for masters of one machine: executors on other hosts could not reach such a driver.
LOCAL_CONF = {"spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"}


def is_local(master: str) -> bool:
    """``local`` or ``local[...]``: driver and executors share one process and its folders."""
    return master == "local" or master.startswith("local[")


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "offerlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    The number of shuffle partitions and the loopback address are set on
    local masters only; a cluster brings its own."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and is_local(master):
        conf.update(LOCAL_CONF)
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it; otherwise (local
    runs, tests) creates a private folder once and registers it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not is_local(spark.sparkContext.master):
            # a machine-local folder is not visible to executors on other hosts
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="offerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path below the shared folder for a written stage table."""
    root = checkpoint_root(spark)
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return os.path.join(root, "stages", leaf)
