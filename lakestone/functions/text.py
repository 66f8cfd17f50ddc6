"""String helpers: null tokens, timestamp text, file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens that mean "no value" in the raw CSV source.
NULL_TOKENS = ("", "NULL", "null", "NA")

# Fixed value: the timestamp text format of the raw sources (no zone, seconds).
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_null_tokens(c, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NULL when the text equals one of ``tokens``, else the text."""
    c = _col(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def iso_seconds(ts) -> Column:
    """Timestamp to ``yyyy-MM-ddTHH:mm:ss`` text (fraction of second dropped)."""
    return F.date_format(_col(ts), ISO_SECONDS)


def file_stem(path) -> Column:
    """File name without directory and extension: ``/a/b/c.parquet`` -> ``c``."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1)
