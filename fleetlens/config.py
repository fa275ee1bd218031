"""Session settings the library relies on.

All time arithmetic is done in UTC, so the session time zone is pinned to UTC.
Shuffle and file-split sizes are left to the caller (cluster) except in the
local builder used by tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session running fleetlens jobs should carry.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}


# Sizing for a large cluster (e.g. 1000 executors x 8 cores reading ~100 TB).
# Shuffles start wide and AQE coalesces them to the advisory size, so one
# setting serves both the hourly roll-ups and full-history jobs; input splits of
# 256 MiB keep scan tasks in memory; AQE only turns a join into a broadcast
# when the measured side is below the threshold.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def apply_cluster_sizing(spark: SparkSession, overrides: dict[str, str] | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` for keys the cluster has not set itself."""
    conf = dict(CLUSTER_CONF, **(overrides or {}))
    defaults = {"spark.sql.shuffle.partitions": "200"}
    for key, value in conf.items():
        current = spark.conf.get(key, None)
        if current is None or current == defaults.get(key):
            spark.conf.set(key, value)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings fleetlens needs to an existing session."""
    for key, value in SESSION_CONF.items():
        try:
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        except Exception:  # static or locked conf: leave it to the cluster
            pass
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "fleetlens") -> SparkSession:
    """A local session for tests and the benchmark (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")   # a checkpoint goes with its last reference
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and versioned tables, named once per Spark context.

    Read from ``spark.checkpoint.dir`` (the cluster's shared storage).  Only a local-mode session
    without one (tests) gets a fresh local folder; on a cluster a missing setting is an error,
    never a machine-local folder.  A folder the context already has is kept, so repeated calls
    neither nest nor leave empty folders behind.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not configured:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                                   "distributed file system) before running jobs that cut lineage")
            configured = tempfile.mkdtemp(prefix="fleetlens-ckpt-")   # local mode only: one machine
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    folder = configured or current
    return folder.rstrip("/") if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)
