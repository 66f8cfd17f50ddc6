"""Writers.  Every table write replaces the target (overwrite), like the file zones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Iterable[str] | None = None) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> str:
    """CSV with a header; NULL is written as an empty field, blanks are kept, quotes doubled."""
    (df.write.mode(mode).option("header", header).option("nullValue", "").option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> str:
    """One JSON object per line, UTF-8, non-ASCII kept; explicit nulls kept by default."""
    (df.write.mode(mode).option("ignoreNullFields", not keep_nulls)
     .option("encoding", "UTF-8").json(path))
    return path


def write_json_document(df: DataFrame, path: str) -> str:
    """A small nested document (catalog, lineage, report) as JSON.

    The frame is one row per document; ``coalesce(1)`` only merges those few rows.  Absent
    values are left out.
    """
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", True).json(path)
    return path


def upload_tables(spark: SparkSession, paths: Iterable[str], lake_uri: str) -> list[str]:
    """Copy each Parquet dataset to ``{lake_uri}/{stem}.parquet``, replacing what is there.

    Each copy is a distributed read and write; the driver only loops over names.
    """
    out = []
    for p in paths:
        stem = p.rstrip("/").rsplit("/", 1)[-1]
        stem = stem[:-len(".parquet")] if stem.endswith(".parquet") else stem
        target = f"{lake_uri.rstrip('/')}/{stem}.parquet"
        spark.read.parquet(p).write.mode("overwrite").parquet(target)
        out.append(target)
    return out
