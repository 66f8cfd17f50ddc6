"""Sources and sinks: CSV with null tokens, NDJSON, Parquet, whole JSON documents,
file discovery, object inventory and a lake base URI (local path or s3a://)."""

from lakestone.sources.readers import (read_csv_tokens, read_ndjson, read_parquet, read_json_document,
                                       read_variant_document, members, discover, inventory, table_path, read_table)
from lakestone.sources.sinks import write_parquet, write_csv, write_ndjson, write_json_document, upload_tables
from lakestone.sources.clustered import write_clustered
from lakestone.sources.lake import s3a_options, configure_lake

__all__ = [
    "read_csv_tokens", "read_ndjson", "read_parquet", "read_json_document", "read_variant_document", "members", "discover", "inventory",
    "table_path", "read_table", "write_parquet", "write_csv", "write_ndjson", "write_json_document", "write_clustered",
    "upload_tables", "s3a_options", "configure_lake",
]
