"""SparkSession settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces partitions from
# runtime statistics, and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "lakestone",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave them
    unset so the cluster's own settings apply.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.driver") and not k.startswith("spark.executor"):
            try:
                spark.conf.set(k, v)
            except PySparkException:  # static confs of an existing session
                pass
    return spark


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a large input (e.g. 100 TB on ~1000 executors).

    Initial shuffle partitions are sized so each holds about ``target_partition_bytes``
    of the input (at least two waves of the cluster's cores); AQE then coalesces small
    ones toward the advisory size and splits skewed join partitions.  Scan splits stay
    at 128-256 MB so a task's input fits executor memory with room for its shuffle
    buffers.
    """
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 256 << 20)),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Where it is unset, a session whose driver and executors are one
    process (master ``local[...]``) gets a folder of its own, registered so that
    ``DataFrame.checkpoint()`` works too; any other session raises, as its executors
    would each write to their own disk.
    """
    try:
        sc = spark.sparkContext
    except PySparkException:  # Spark Connect: only the session configuration is visible
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="lakestone-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused, never deleted here)."""
    return f"{shared_dir(spark)}/lakestone/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side checks in tests."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["get_spark", "cluster_conf", "shared_dir", "scratch_path", "local_path", "DEFAULT_CONF"]
