"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of 2**60 positions; a key belongs to the
first point clockwise of its hash.  No shard takes more than its capacity: keys beyond it
continue clockwise to the next shard with room.  With ``load_factor`` c > 1 the capacity
is ceil(c * rows / shards); with 1.0 capacities are floor or ceil of rows / shards, so the
counts of any two shards differ by one at most.

The ring walk needs only the number of keys per ring piece, which is bounded by
``shards * vnodes + CELLS`` whatever the table holds.  It runs in rounds: in round r the
keys still without a shard ask the r-th distinct shard clockwise, which accepts them in
ring order until it is full.  A key's own place follows from its rank in its piece.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

RING = 1 << 60
#: Equal cells of the ring; virtual nodes are cut at their borders so that a key finds its arc by an equi-join.
CELLS = 4096
_CELL_BITS = 48


def position(key: Column) -> Column:
    """Ring position: the first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _at(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; shard s keeps its points for any number of shards."""
    return sorted((_at(f"shard-{s}:{v}"), s) for s in range(shards) for v in range(vnodes))


def pieces(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): the ring cut at virtual nodes and cell borders, bounds inclusive, in ring order."""
    width, out, low, arc = RING // CELLS, [], 0, 0
    while low < RING:
        while arc < len(points) and points[arc][0] < low:
            arc += 1
        end = (low // width + 1) * width - 1
        high = min(end, points[arc][0]) if arc < len(points) else end
        out.append((low // width, low, high, arc % len(points)))
        low = high + 1
    return out


def preferences(points: list[tuple[int, int]]) -> list[list[int]]:
    """For each arc, the distinct shards clockwise from it."""
    shards, out = {s for _, s in points}, []
    for i in range(len(points)):
        seen: list[int] = []
        for k in range(len(points)):
            s = points[(i + k) % len(points)][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == len(shards):
                    break
        out.append(seen)
    return out


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1.0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load_factor * rows // shards)] * shards


def place(counts: list[int], preferred: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first key, last key + 1, shard, slot of the first key) for all keys of all arcs."""
    left, taken, used, out = list(counts), [0] * len(counts), [0] * len(room), []
    for r in range(len(room)):
        for arc, n in enumerate(left):
            if n:
                s = preferred[arc][r]
                got = min(n, room[s] - used[s])
                if got > 0:
                    out.append((arc, taken[arc], taken[arc] + got, s, used[s]))
                    left[arc] -= got
                    taken[arc] += got
                    used[s] += got
    return out


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 64, load_factor: float = 1.0,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, home, shard, slot) for every row of ``docs``.

    ``home`` is the shard that the plain ring would give, ``slot`` the gapless position
    within the shard.  Null texts have no bytes (size 1, checksum 0); null keys hash as
    the empty string; rows with equal keys fill neighbouring places and overflow like any
    other; repeated rows each get a slot; an empty table gives an empty result.  Other
    columns are not carried: join on the key.
    """
    spark = docs.sparkSession
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    points = ring(shards, vnodes)
    cut = pieces(points)
    table = spark.createDataFrame([(c, lo, hi, i) for i, (c, lo, hi, _) in enumerate(cut)],
                                  "cell int, low long, high long, piece int")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("_size"),
                       F.crc32(body.cast("binary")).alias("_crc"))
    rows = rows.withColumn("_pos", position(F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    rows = rows.withColumn("_ring_cell", F.shiftright("_pos", _CELL_BITS).cast("int"))
    rows = rows.join(F.broadcast(table), (F.col("_ring_cell") == F.col("cell"))
                     & F.col("_pos").between(F.col("low"), F.col("high")))
    found = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()  # at most shards * vnodes + CELLS rows
    per_piece = [0] * len(cut)
    for x in found:
        per_piece[x["piece"]] = x["n"]
    start, per_arc = [0] * len(cut), [0] * len(points)
    for i, (_, _, _, arc) in enumerate(cut):
        start[i] = per_arc[arc]
        per_arc[arc] += per_piece[i]
    by_arc: dict[int, list] = {}
    for seg in place(per_arc, preferences(points), capacities(sum(per_arc), shards, load_factor)):
        by_arc.setdefault(seg[0], []).append(seg)
    segments = [(i, max(lo - start[i], 0), min(hi - start[i], per_piece[i]), points[arc][1], s,
                 slot + max(start[i] - lo, 0) - max(lo - start[i], 0))
                for i, (_, _, _, arc) in enumerate(cut) for _, lo, hi, s, slot in by_arc.get(arc, ())
                if lo < start[i] + per_piece[i] and hi > start[i]]
    places = spark.createDataFrame(segments, "p int, first long, last long, home int, shard int, base long")
    order = ["_pos", "_key", "_size", "_crc"]
    # Sub-cells of a piece follow the positions; a task numbers one of CELLS * 8 stretches of the ring.
    numbered = ranked(rows, ["piece"], order, F.shiftright("_pos", _CELL_BITS - 3).cast("int"))
    return (numbered.join(F.broadcast(places), (F.col("piece") == F.col("p"))
                          & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")))
            .select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                    "home", "shard", (F.col("base") + F.col("_rank")).alias("slot")))
