"""Readers.  All take explicit schemas; none infers types from the data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakestone.functions.text import NULL_TOKENS, clean_null_tokens
from lakestone.schemas import string_schema
from lakestone.sources.quoted_csv import read_quoted_csv


def table_path(base_uri: str, table: str, ext: str = ".parquet") -> str:
    """``{base}/{table}{ext}``; the base is a local folder or an ``s3a://bucket/prefix``."""
    return f"{base_uri.rstrip('/')}/{table}{ext}"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, base_uri: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(base_uri, table))


def read_csv_tokens(spark: SparkSession, path: str, schema: StructType,
                    null_tokens: Sequence[str] = NULL_TOKENS, header: bool = True,
                    sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV with a header where any of ``null_tokens`` means NULL in any column.

    Spark's ``nullValue`` takes a single token, so every field is read as text, the
    tokens are nulled, and each column is then cast to its declared type.  The cast is
    strict (ANSI): a value that is not a token and does not parse fails the job, like a
    typed reader would.  Inside quotes a quote is doubled and a backslash is itself; blanks
    are kept.  ``multi_line`` allows line breaks inside quotes; record starts are then found
    by a scan of the file's blocks (see ``quoted_csv``), so a file is still many tasks.
    """
    if multi_line:
        return typed_columns(read_quoted_csv(spark, path, string_schema(schema), header, sep), schema, null_tokens)
    raw = (spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
           .option("mode", "FAILFAST").schema(string_schema(schema)).csv(path))
    return typed_columns(raw, schema, null_tokens)


def typed_columns(raw: DataFrame, schema: StructType, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text columns with the tokens nulled, cast strictly to ``schema``."""
    cols = []
    for f in schema.fields:
        cleaned = clean_null_tokens(F.col(f.name), null_tokens)
        cols.append((cleaned if isinstance(f.dataType, StringType) else cleaned.cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line, fields in the declared order; malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A whole (possibly pretty-printed) JSON document per file: one row per file.

    Nested fields are then reached with dotted paths and ``size`` of arrays.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_variant_document(spark: SparkSession, path: str, name: str = "doc") -> DataFrame:
    """A whole JSON document per file as one VARIANT column: read as it is, no schema declared or inferred."""
    return spark.read.format("json").option("singleVariantColumn", name).option("multiLine", True).load(path)


def members(df: DataFrame, variant: Column, key: str, value: str) -> DataFrame:
    """``df`` with one row for each member of an object (or element of an array): its ``key`` and VARIANT ``value``.

    An array's elements have a NULL key.  Rows whose ``variant`` is NULL or a plain value give none.
    """
    found = df.sparkSession.tvf.variant_explode(variant.outer())
    return df.lateralJoin(found.select(F.col("key").alias(key), F.col("value").alias(value)))


def discover(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> list[str]:
    """Sorted top-level entries of ``folder`` holding files that match ``pattern``.

    A single file (``x.parquet``) and a dataset folder written by Spark
    (``x.parquet/part-*.parquet``) are both one entry.  Only file metadata is read (the
    content column is pruned), and only the distinct entry names reach the driver.  The
    folder may be a bare path, ``file:/``, ``file:///`` or any other URI.  An empty listing
    raises.
    """
    base = folder.rstrip("/")
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", True).load(base).select("path"))
    # Both sides without scheme and authority, which listings spell in their own way.
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", base)
    entry = F.regexp_extract(F.substr(plain, F.lit(len(root) + 1)), r"^/([^/]+)", 1)
    names = (listing.filter(plain.startswith(f"{root}/")).select(entry.alias("e"))
             .filter(F.col("e") != "").distinct().collect())
    if not names:
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return sorted(f"{base}/{r.e}" for r in names)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Object inventory: file name and size in KB, one row per object."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(folder))
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("object_name"),
        F.col("length").alias("size_bytes"),
        (F.col("length") / F.lit(1024.0)).alias("size_kb"),
    )
