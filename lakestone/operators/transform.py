"""The heavy per-row transform over a table, and a user hook for Python record functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakestone.functions.transform import hash_prefix, trig_score


def heavy_transform(df: DataFrame, user: str = "user_id", category: str = "category",
                    value: str = "value", text: str = "text") -> DataFrame:
    """(user_id, category, score, hash_prefix) per row, as native column expressions.

    Spark partitions the table and runs the projection in generated code on every
    core; this is the parallel map, with no record pickling and no Python worker.
    """
    return df.select(F.col(user).alias("user_id"), F.col(category).alias("category"),
                     trig_score(value).alias("score"), hash_prefix(text, user).alias("hash_prefix"))


def map_records(df: DataFrame, fn: Callable[[dict], tuple], schema: str,
                batch_size: int = 1000) -> DataFrame:
    """User hook: apply a Python function to each record, in Arrow batches per partition.

    Only for logic that has no column-expression form; ``heavy_transform`` is the fast path.
    """
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                rows = [fn(rec) for rec in chunk.to_dict("records")]
                yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)
