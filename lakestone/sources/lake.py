"""Object-store access: the lake is a base URI, ``s3a://bucket/prefix`` or a folder.

The S3-compatible endpoint settings are Hadoop options.  Spark copies session SQL
settings into the Hadoop configuration of each file scan, so they can be set at run
time with ``spark.conf.set`` (no restart, no client library in the driver).
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def s3a_options(endpoint: str, access_key: str, secret_key: str,
                ssl: bool = False, path_style: bool = True) -> dict[str, str]:
    return {
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.access.key": access_key,
        "fs.s3a.secret.key": secret_key,
        "fs.s3a.connection.ssl.enabled": str(ssl).lower(),
        "fs.s3a.path.style.access": str(path_style).lower(),
    }


def configure_lake(spark: SparkSession, options: dict[str, str]) -> None:
    """Apply object-store options to this session (needs the hadoop-aws jars on a cluster)."""
    for k, v in options.items():
        spark.conf.set(k, v)
