"""Session construction and lineage cutting.

The checkpoint folder is read from the session (``spark.checkpoint.dir``, the
shared folder a cluster names). Only a local-mode session without that setting
(tests, a laptop) gets a fresh scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files are removed once the checkpointed data is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "cinderwell",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    The session time zone is pinned to UTC: event timestamps are parsed as UTC
    and day differences are computed on epoch microseconds.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only in
    local mode when the session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster job needs a shared "
                "checkpoint folder")
        configured = tempfile.mkdtemp(prefix="cinderwell-ckpt-", dir="/tmp")
    os.makedirs(configured, exist_ok=True) if configured.startswith("/") else None
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stable_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable (file-backed) checkpoint: survives executor loss and freezes
    partition contents, so several passes over it see the same rows in the
    same partitions. The frame is persisted while the checkpoint is written,
    so its lineage runs once, not twice."""
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Make a working folder, if it is not there, that goes when the
    application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def written_table(df: DataFrame, what: str) -> DataFrame:
    """The frame written once as Parquet below the shared checkpoint folder
    and read back: lineage is cut, and the optimizer knows its size in bytes.
    The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.parquet(path)


class passes_over:
    """Context manager for multi-pass operators: the (narrow) frame is
    persisted for the passes and released afterwards. Lost partitions are
    recomputed from lineage, so an executor loss costs time, not results."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __enter__(self) -> DataFrame:
        return self.df.persist(StorageLevel.MEMORY_AND_DISK)

    def __exit__(self, *exc):
        self.df.unpersist()
        return False
