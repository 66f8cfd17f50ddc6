"""Bronze ingestion as a Structured Streaming query over a folder of raw files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from lakestone.functions.text import NULL_TOKENS
from lakestone.schemas import string_schema
from lakestone.sources.readers import typed_columns


def ingest_files(spark: SparkSession, source_dir: str, fmt: str, schema: StructType, target: str,
                 checkpoint: str, null_tokens=NULL_TOKENS, max_files_per_trigger: int | None = None,
                 available_now: bool = True):
    """Append every new raw file of ``source_dir`` to the Parquet table ``target``.

    ``fmt`` is ``csv`` (header, null tokens, strict casts), ``ndjson`` or ``parquet``.  With
    ``available_now`` the query processes what is there and stops (a scheduled job);
    otherwise it keeps running.  Returns the ``StreamingQuery``.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        raw = (reader.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
               .schema(string_schema(schema)).csv(source_dir))
        rows = typed_columns(raw, schema, null_tokens)
    elif fmt == "ndjson":
        rows = reader.option("mode", "FAILFAST").schema(schema).json(source_dir)
    elif fmt == "parquet":
        rows = reader.schema(schema).parquet(source_dir)
    else:
        raise ValueError(f"unsupported raw format: {fmt}")
    writer = (rows.writeStream.format("parquet").option("path", target)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
