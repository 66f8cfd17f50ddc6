"""Incremental ingestion with Structured Streaming.

The source system has no streaming operators.  What it does have is a bronze zone that
stores raw files unchanged; on a cluster that zone is naturally fed incrementally.
``ingest_files`` is that bronze step as a file-source stream: new raw files are read
with the declared schema and appended to the bronze Parquet table, exactly once, with
progress kept in a checkpoint folder.  Silver stays a batch step, because its duplicate
rule flags every copy of a key, which needs all rows, not only the new ones.
"""

from lakestone.streaming.ingest import ingest_files

__all__ = ["ingest_files"]
