"""Importance resampling towards a target distribution, over hashed word n-grams.

A text is lower-cased, its separators collapse to single spaces, and for each n an overlapped
regex scan between boundary lookarounds finds every run of n words as one span of bytes,
whose CRC-32 gives the bucket.  The spans are scanned once and the buckets written; the bucket
counts of the corpus and of the target give each bucket's gain, gains give a document's
weight, and a Gumbel draw by hash turns weights into a sample without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.session import scratch_path

from .prefix import laid, spread

SEPARATORS = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores are whole thousandths of a log, so their histogram has few rows: gains and draws are within +-50,000.
SCALE = 1000


def spans(text: str, most: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``most`` consecutive words, joined by one space."""
    plain = re.sub(SEPARATORS, b" ", text.encode().lower()).strip(b" ")
    found: list[bytes] = []
    for n in range(1, most + 1):
        run = regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))
        found += [m.group() for m in run.finditer(plain, overlapped=True)]
    return plain.count(b" ") + 1 if plain else 0, found


def features(docs: DataFrame, most: int, buckets: int, text: str, key: str | None = None) -> DataFrame:
    """(key, n_words, buckets): the ascending buckets of a text's features, repeats kept; null has none."""
    own = F.lit(None).cast("long") if key is None else F.col(key)
    rows = docs.select(own.alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lists = [], []
            for t in batch["_text"]:
                n, found = spans(t.as_py() or "", most)
                words.append(n)
                lists.append(np.sort(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets).astype(np.int32))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["_key"], pa.array(words, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["_key", "n_words", "buckets"])

    return rows.mapInArrow(run, f"_key {kind}, n_words long, buckets array<int>")


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: no more numbers than buckets reach the driver."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored, scaled log of the target's smoothed share over the corpus's."""
    m = len(corpus)
    up = (target + 1).astype(float) * float(corpus.sum() + m)
    down = (corpus + 1).astype(float) * float(target.sum() + m)
    return np.floor(SCALE * np.log(up / down)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of a document's features (none: 0)."""
    kind = dict(found.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["buckets"]
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays(
                [batch["_key"], batch["n_words"], pa.array(n), pa.array(np.floor_divide(total, np.maximum(n, 1)))],
                names=["_key", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """A scaled Gumbel draw that the seed and the key (null: the empty text) decide."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10000, percent: int = 10,
             least_words: int = 20, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with ``least_words`` words, ``percent`` per cent (rounded down) are drawn: those of
    the highest scores, equal scores by ascending key (a null key first), repeated rows side by
    side; ``rank`` counts them from 1 and is null for the others.  Null and wordless texts have no
    feature and weight 0.  An empty ``docs`` gives no rows; with an empty ``target`` all weights come
    from the corpus alone.  Other columns are not carried, whatever their names.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "importance-features")
    features(docs, most, buckets, text, key).write.parquet(path)
    found = spark.read.parquet(path)
    gain = gains(histogram(found, buckets), histogram(features(target, most, buckets, text), buckets))
    path = scratch_path(spark, "importance-scores")
    weighed(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("_key"), seed)).write.parquet(path)
    scored = spark.read.parquet(path)
    able = F.col("n_words") >= least_words
    counts = sorted(scored.where(able).groupBy("score").count().collect(), reverse=True)  # bounded: see SCALE
    want = percent * sum(n for _, n in counts) // 100
    seen, cut = 0, None
    for score, n in counts:
        if seen >= want:
            break
        seen, cut = seen + n, score
    near = able & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    columns = ["_key", "n_features", "weight", "score"]
    order = laid(scored.where(near).select((-F.col("score")).alias("_down"), *columns), [], ["_down", *columns])
    drawn = spread(order).select(*columns, F.when(F.col("_start") < want, F.col("_start") + 1).cast("long").alias("rank"))
    rest = scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("_key", key)
