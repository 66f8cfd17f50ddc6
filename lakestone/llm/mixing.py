"""Mixing sources to target weights: fixed-length blocks of words, drawn into output shards.

The documents of a source, one after the other, are its stream; every ``block_words`` words of
it are a block, the rest a short last one.  A source's slots are its passes over these blocks:
slot j is block ``permute(j)`` of pass ``j // blocks``, where a Feistel network permutes the
source's whole blocks and the short block ends each pass.  The last slot is cut where the
target is reached, so a source gives its target to the word.

Each shard's counts of the sources come from multinomial draws given that they add up to the
sources' slots: a source's slots are split among halves of the shards by binomial draws, among
the shards of a chunk by one multinomial draw.  A draw depends on the seed, the source and the
chunk alone, so each chunk finds its own counts and first slots, on any executor and in any rerun.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.session import scratch_path

from .merkle import field
from .prefix import laid, spread
from .textops import U64, mix as _hash

TOKEN = r"[^\x20\x09-\x0D]+"
#: Words of a block, expected blocks of an output shard, shards of a chunk.
BLOCK_WORDS, SHARD_BLOCKS, CHUNK_SHARDS = 512, 1024, 64
#: Slots that a task hands on at a time.
BATCH = 65536

_SLOTS = "source string, shard long, place long, pass long, block long, words long"


class Mixed(NamedTuple):
    documents: DataFrame
    """(key, source, size, start) of every row; ``start`` is its first word in the source's stream."""
    sources: DataFrame
    """(source, size, target)."""
    spans: DataFrame
    """(shard, place, source, pass, block, key, size, start, first_word, n_words): the words of each slot's block."""


def _rng(*name: object) -> np.random.Generator:
    key = hashlib.sha256("\0".join(map(str, name)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(key[:16], "little")))


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of ``index`` under a permutation of 0 to n-1: a Feistel network, walked until it is back inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, out = U64((1 << half) - 1), index.astype(U64)
    keys = _hash(np.arange(1, 5, dtype=U64) + U64(seed))
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> U64(half), out[todo] & mask
        for k in keys:
            a, b = b, a ^ (_hash(b ^ k) & mask)
        out[todo] = a << U64(half) | b
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def split(slots: int, shards: int, chunk: int, name: tuple) -> tuple[int, np.ndarray]:
    """First slot of a chunk of shards, and the slots of each of its shards."""
    low, high, first = 0, shards, 0
    while high - low > CHUNK_SHARDS:
        middle = low + -(-((high - low) // 2) // CHUNK_SHARDS) * CHUNK_SHARDS
        left = int(_rng(*name, low, high).binomial(slots, (middle - low) / (high - low)))
        if chunk * CHUNK_SHARDS < middle:
            high, slots = middle, left
        else:
            low, slots, first = middle, slots - left, first + left
    return first, _rng(*name, low, high).multinomial(slots, np.full(high - low, 1 / (high - low)))


def _draw(source: str, size: int, words: int, chunk: int, shards: int, block: int, seed: int) -> Iterator[pd.DataFrame]:
    whole, passes, rest = size // block, words // size, words % size
    each, last = -(-size // block), -(-rest // block)
    slots = passes * each + last
    first, counts = split(slots, shards, chunk, (seed, source))
    ends = np.cumsum(counts)
    own = int.from_bytes(hashlib.sha256(f"{seed}\0{source}".encode()).digest()[:7], "little")
    for low in range(0, int(ends[-1]), BATCH):
        i = np.arange(low, min(low + BATCH, int(ends[-1])))
        j = first + i
        at = j % each
        inside = at < whole
        at[inside] = permute(at[inside], whole, own)
        n = np.where(inside, block, size - whole * block)
        if last:
            n[j == slots - 1] = rest - (last - 1) * block
        yield pd.DataFrame({"source": source, "shard": chunk * CHUNK_SHARDS + np.searchsorted(ends, i, "right"),
                            "place": _hash(j.astype(U64) ^ U64(own)).view(np.int64), "pass": j // each, "block": at, "words": n})


def sources(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, size, target, name): names by code point, null last, weigh ``weights`` in turn.

    Together they share ``share`` times all sizes; what a source's weight gives it beyond
    ``cap`` times its size is shared by the others, by weight, until none is above.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("name").agg(F.sum("size").alias("size"))
    ranked = laid(totals.select(F.col("name").isNull().alias("_none"), "name", "size"), [], ["_none", "name", "size"])
    turn = F.array(*[F.lit(w) for w in weights])
    path = scratch_path(spark, "mix-sources")
    (ranked.select(field(F.col("name")).alias("source"), "name", "size",
                   F.get(turn, F.pmod(F.col("_start"), F.lit(len(weights))).cast("int")).alias("weight")).write.parquet(path))
    table = spark.read.parquet(path)
    total, all_weights = table.agg(F.sum("size"), F.sum("weight")).first()
    level, capped = share * (total or 0) / (all_weights or 1), 0
    while True:  # ends: every round caps a source more, or is the last
        above = F.col("weight") * F.lit(level) > cap * F.col("size")
        n, held, left = table.agg(F.count_if(above), F.sum(F.when(above, cap * F.col("size"))),
                                  F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (share * total - held) / left, n
    target = F.least(F.col("weight") * F.lit(float(level)), (cap * F.col("size")).cast("double"))
    return table.select("source", "name", "size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 7,
        block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, text: str = "text", source: str = "source",
        key: str = "doc_id") -> Mixed:
    """The mix of ``docs``: its documents' places, its sources' targets and the spans of its shards.

    Sizes are words ``TOKEN`` (null and empty texts: none, and no span).  A null source is a
    source, the last.  A source's words are its target's, rounded; a document's are taken at most
    ``cap`` times.  Inside a shard slots stand in the order of ``place``.  Equal keys and repeated
    rows are documents of their own.  An empty table gives empty tables; other columns are not
    carried, whatever their names.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long")
    rows = docs.select(F.col(source).alias("name"), F.col(key).alias("_key"), words.alias("size"))
    runs = laid(rows, ["name"], ["_key", "size"], F.col("size"))
    placed = spread(runs, F.col("size")).select(field(F.col("name")).alias("source"), "name", "_key", "size",
                                                F.col("_start").alias("start"))
    path = scratch_path(spark, "mix-documents")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    path = scratch_path(spark, "mix-targets")
    sources(placed.select("name", "size"), weights, share, cap).write.parquet(path)
    targets = spark.read.parquet(path)

    wanted = F.floor(F.col("target") + 0.5).cast("long")
    slots = targets.agg(F.sum(F.ceil(wanted / block_words))).first()[0] or 0
    shards = max(1, -(-slots // shard_blocks))
    chunks = -(-shards // CHUNK_SHARDS)
    drawn_from = (targets.select("source", "size", wanted.alias("words")).where("words > 0")
                  .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
                  .repartition("source", "chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, size, words, chunk in batch[["source", "size", "words", "chunk"]].itertuples(index=False):
                yield from _draw(s, int(size), int(words), int(chunk), shards, block_words, seed)

    slot_rows = drawn_from.mapInPandas(run, _SLOTS)
    parts = (placed.where("size > 0")
             .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})"))))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    # Both sides grow with the corpus, though Spark can't tell it of rows that a function makes.
    spans = (parts.join(slot_rows.hint("merge"), ["source", "block"]).withColumn("_n", end - begin).where("_n > 0")
             .select("shard", "place", "source", "pass", "block", F.col("_key").alias(key), "size", "start",
                     (begin - F.col("start")).alias("first_word"), F.col("_n").alias("n_words")))
    return Mixed(placed.select(F.col("_key").alias(key), "source", "size", "start"),
                 targets.select("source", "size", "target"), spans)


def taken(mixed: Mixed, key: str = "doc_id") -> DataFrame:
    """(key, source, size, start, taken): the words that the mix takes of every row, repeats counted."""
    keys = [key, "source", "size", "start"]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = (mixed.documents.select(*keys, zero.alias("n"), one.alias("rows"))
               .unionByName(mixed.spans.select(*keys, F.col("n_words").alias("n"), zero.alias("rows")))
               .groupBy(*keys).agg(F.sum("n").alias("taken"), F.sum("rows").alias("_rows")))
    # Only rows without words can be equal here; each is a row of the result.
    return counted.withColumn("_copy", F.explode(F.sequence(one, F.col("_rows")))).drop("_copy", "_rows")


def contents(docs: DataFrame, mixed: Mixed, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(shard, place, source, pass, block, text): the words of every slot, joined by one space.

    Spans meet the texts on (key, source, size); of rows equal in these the first text by order is
    taken, so give distinct keys where texts differ.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    texts = (docs.select(F.col(key).alias("_k"), field(F.col(source)).alias("_s"), F.col(text).alias("_t"),
                         F.regexp_count(body, F.lit(TOKEN)).cast("long").alias("_n"), found.alias("_words"))
             .groupBy("_k", "_s", "_n").agg(F.min_by("_words", "_t").alias("_words")))
    cut = mixed.spans.join(texts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("source") == F.col("_s")) & (F.col("size") == F.col("_n")))
    piece = F.struct("start", F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("words"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["words"]))
    return cut.groupBy("shard", "place", "source", "pass", "block").agg(F.array_join(joined, " ").alias("text"))
