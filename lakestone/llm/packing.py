"""Packing into optimal length buckets.

A dynamic program over the global length histogram picks the bucket boundaries that
minimise padding; inside a bucket, documents form batches of at most ``token_budget``
padded tokens.  The histogram is the only thing the driver sees: exact, one entry for each
length that occurs, so no more than the longest document has tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

TOKEN = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket that one task numbers, about.
CELL_ROWS = 65536


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens plus one end token; null counts as empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)) + 1).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bucket maxima, ascending, that minimise sum(count * bucket maximum).

    ``lengths`` ascend.  best[j] is the least cost of the first j lengths; the position of
    the last cut never moves back as j grows, so each layer is solved by halving.
    """
    m = len(lengths)
    buckets = min(buckets, m)
    if not m:
        return []
    top = np.asarray(lengths, np.float64)
    seen = np.concatenate(([0.0], np.cumsum(np.asarray(counts, np.float64))))
    best = np.concatenate(([0.0], np.full(m, np.inf)))
    cuts = []
    for _ in range(buckets):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        work = [(1, m, 0, m - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + top[j - 1] * (seen[j] - seen[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            work += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j > 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65536, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, bucket, bucket_len, batch, place, padding) for every row.

    ``bucket_len`` is the bucket's padded length, ``batch`` counts within the bucket and
    holds at most max(1, token_budget // bucket_len) documents, ``place`` is the position
    in the batch.  Only the last batch of a bucket can be short.  Documents are neither
    split nor cut: one longer than the budget is a batch of its own.  Null and empty texts
    have the end token only; repeated rows each get a place; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), token_count(F.col(text)).alias("_n"),
                       F.crc32(body.cast("binary")).alias("_crc"))
    histogram = sorted((x["_n"], x["rows"]) for x in rows.groupBy("_n").agg(F.count(F.lit(1)).alias("rows")).collect())
    tops = boundaries([g for g, _ in histogram], [c for _, c in histogram], buckets)
    total = sum(c for _, c in histogram)
    bucket = F.lit(None).cast("int")
    for b, t in reversed(list(enumerate(tops))):
        bucket = F.when(F.col("_n") <= t, F.lit(b)).otherwise(bucket)
    tops_of = F.array(*[F.lit(t).cast("long") for t in tops]) if tops else F.array().cast("array<bigint>")
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.get(tops_of, F.col("bucket")))
    order = ["_key", "_n", "_crc"]
    cell = F.pmod(F.xxhash64(*order), F.lit(total // CELL_ROWS + 1)).cast("long")
    out = ranked(placed, ["bucket", "bucket_len"], order, cell)
    each = F.greatest(F.lit(1), F.expr(f"{int(token_budget)} div bucket_len"))
    return out.select(F.col("_key").alias(key), F.col("_n").alias("n_tokens"), "bucket", "bucket_len",
                      F.floor(F.col("_rank") / each).alias("batch"), F.pmod(F.col("_rank"), each).alias("place"),
                      (F.col("bucket_len") - F.col("_n")).alias("padding"))
