"""Session helpers for tests, the benchmark and local runs.

Library functions never create a session; jobs receive the caller's. These
helpers only fill settings that are unset, so a cluster's configuration wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Else every Column call from Python looks up its place in the source, for error messages:
    # a third of the time that building a pricing plan takes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "riskprice",
                  driver_memory: str = "8g", event_log_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark. ``event_log_dir`` writes Spark's
    event log (stage and task times) to that folder; the web UI stays off."""
    if "spark.checkpoint.dir" not in (extra or {}) and not os.environ.get("SPARK_CONF_DIR"):
        extra = {**(extra or {}), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskprice-ckpt-")}
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**LOCAL_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(ensure_checkpoint_dir(spark))
    return spark


_LOCAL_CHECKPOINTS: dict = {}


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:                   # Spark Connect: never assume a local machine
        return False


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a shared file system) and an unset value is an
    error; only a local-mode session without it gets a private scratch folder.
    The session's settings are read, never changed."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not _is_local(spark):
        raise ValueError("spark.checkpoint.dir is not set: name a shared folder "
                         "(HDFS/S3) for checkpoints, or pass a checkpoint location")
    if "local" not in _LOCAL_CHECKPOINTS:
        _LOCAL_CHECKPOINTS["local"] = tempfile.mkdtemp(prefix="riskprice-ckpt-")
    return _LOCAL_CHECKPOINTS["local"]


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), *parts)
