"""Fixed-size filters of key hashes: a bitmap that says "surely not there" for most keys.

A filter has the same number of bits whatever the tables hold, so it may be sent to every
task.  A row whose bit is unset needs no join; the others are still compared by their exact
keys.  Where the filter is full, every row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (8 MB as 64-bit words).
FILTER_BITS = 1 << 26


def filter_words(hashes: DataFrame, by: list[str] | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """(by, ``word``, ``mask``): one filter for each value of ``by``, from the long column ``hash``.

    Hashes are dealt by word before they are put together, so a task holds its own words only.
    """
    keys = by or []
    slot = F.pmod(F.col("hash"), F.lit(bits))
    return (hashes.select(*keys, F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit"))
            .repartition(*keys, "word").groupBy(*keys, "word")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask")))


def with_possible(df: DataFrame, words: DataFrame, hashed: Column, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with boolean ``name``: whether the filter ``words`` (``word``, ``mask``) has the bit of ``hashed``.

    Columns ``__slot``, ``__word`` and ``__mask`` are the operator's own while it works.
    """
    return _met(df, words, hashed, bits, "left").withColumn(name, F.coalesce(_set(), F.lit(False))).drop("__slot", "__word", "__mask")


def only_possible(df: DataFrame, words: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose bit is set."""
    return _met(df, words, hashed, bits, "inner").where(_set()).drop("__slot", "__word", "__mask")


def _set() -> Column:
    return F.getbit(F.col("__mask"), (F.col("__slot") % 64).cast("int")) == 1


def _met(df: DataFrame, words: DataFrame, hashed: Column, bits: int, how: str) -> DataFrame:
    own = F.broadcast(words.select(F.col("word").alias("__word"), F.col("mask").alias("__mask")))
    return df.withColumn("__slot", F.pmod(hashed, F.lit(bits))).join(own, F.shiftright(F.col("__slot"), 6) == F.col("__word"), how)
