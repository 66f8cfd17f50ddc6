"""Blocks of documents and exact lookups of their hashed keys against the whole corpus.

Documents are dealt into blocks of bounded text.  A block sends each of its distinct keys
once, packed by key range; the range's task sums what all blocks sent and answers with one
value per key in the block's own order; the answers meet the block again.  So a key shared
by a third of the corpus costs one entry a block, and texts are moved once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Characters of text in a block, about, and characters of corpus behind one key range.
BLOCK_CHARS, RANGE_CHARS = 4 << 20, 16 << 20

SENT = "range long, block long, level int, keys binary, values binary"
SENT_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
ANSWER = "block long, range long, level int, answers binary"
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("level", pa.int32()), ("answers", pa.binary())])


def dealt(docs: DataFrame, block_chars: int = BLOCK_CHARS, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """``docs`` with a ``_block`` column and partitioned by it, and the number of key ranges.

    The number of blocks follows the total length of the texts, a row's block its key and text.
    """
    chars = docs.agg(F.sum(F.length(F.col(text)) + 1)).first()[0] or 0
    blocks, ranges = max(1, -(-chars // block_chars)), max(1, -(-chars // (block_chars * (RANGE_CHARS // BLOCK_CHARS))))
    keyed = docs.withColumn("_block", F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("long"))
    return keyed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_block"), ranges


def planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: leading zeros then lie together, where compression finds them.

    Of rows of numbers the columns follow each other, so a constant one costs next to nothing.
    """
    a = np.ascontiguousarray(a.T).reshape(-1)
    whole = a.view(f"<u{a.itemsize}")
    out = np.empty((a.itemsize, len(a)), np.uint8)
    for i, plane in enumerate(out):  # by shifts, which run through the numbers in their order
        np.copyto(plane, whole >> whole.dtype.type(8 * i), casting="unsafe")
    return out.tobytes()


def from_planes(data: bytes, kind: str | type, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize
    found = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
    return found.reshape(width, -1).T if width > 1 else found


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, U64), dtype=U64)


def split(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The stretches of ascending distinct keys that fall into each key range."""
    if not len(keys):
        return []
    at = (keys >> U64(40)).astype(np.int64) * ranges >> 24
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[a]), slice(a, b)) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True)]


def send(block: int, ranges: int, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Packed rows of (level, ascending distinct keys, one value or row of values for each)."""
    rows: list[list] = [[], [], [], [], []]
    for level, keys, values in levels:
        for r, s in split(keys, ranges):
            for column, x in zip(rows, (r, block, level, pack_keys(keys[s]), planes(values[s])), strict=True):
                column.append(x)
    return pa.table([pa.array(c, f.type) for c, f in zip(rows, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def own(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (block, level, data) that come back to their block as they are."""
    return pa.table([pa.array(c, f.type) for c, f in zip(
        ([-1 - b for b, _, _ in rows], [b for b, _, _ in rows], [v for _, v, _ in rows], [x for _, _, x in rows], [None] * len(rows)),
        SENT_ARROW, strict=True)], schema=SENT_ARROW)


def answered(sent: DataFrame, reduce: Callable[[int, np.ndarray, list[np.ndarray], list[np.ndarray]], list[np.ndarray]],
             value_type: str, width: int = 1) -> DataFrame:
    """Answers of every (range, level).

    ``reduce(level, keys, where, values)`` gets the range's distinct keys and, for every
    packet, the places of its keys and its values; it returns one array per packet.
    Rows of ``own`` come back as they are.
    """
    def run(table: pa.Table) -> pa.Table:
        level = table["level"][0].as_py()
        if table["range"][0].as_py() < 0:
            return pa.table([table["block"], table["range"], table["level"], table["keys"]], schema=ANSWER_ARROW)
        packets = [unpack_keys(x) for x in table["keys"].to_pylist()]
        values = [from_planes(x, value_type, width) for x in table["values"].to_pylist()]
        distinct, place = np.unique(np.concatenate(packets), return_inverse=True)
        ends = np.cumsum([len(p) for p in packets])
        answers = reduce(level, distinct, np.split(place, ends[:-1]), values)
        return pa.table([table["block"], table["range"], table["level"],
                         pa.array([planes(a) for a in answers], pa.binary())], schema=ANSWER_ARROW)

    return sent.groupBy("range", "level").applyInArrow(run, ANSWER)


def joined(table: pa.Table, kinds: dict[int, str], widths: dict[int, int] | None = None) -> dict[int, np.ndarray]:
    """A block's answers by level, in the order of its ascending keys."""
    out: dict[int, list] = {level: [] for level in kinds}
    for level, _, data in sorted(zip(table["level"].to_pylist(), table["range"].to_pylist(), table["answers"].to_pylist(), strict=True)):
        out[level].append(from_planes(data, kinds[level], (widths or {}).get(level, 1)))
    return {level: np.concatenate(x) if x else np.zeros((0, w) if (w := (widths or {}).get(level, 1)) > 1 else 0, kinds[level])
            for level, x in out.items()}


