"""CSV whose quoted fields hold line breaks, read by as many tasks as the file has blocks.

A block of a file can't tell whether its first line begins a record or goes on inside a
quoted field.  So every block is first scanned for what it does to either case: a function
from {record start, inside quotes} to the same two.  Running these functions over a file's
blocks (a window over one row a block) gives the case each block really begins in.  The second
scan then joins the lines of a block to records; a record that crosses a border is sent as
fragments to the block it begins in.  Only fragments and one row a block are ever shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What tasks run travels by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
#: What a row of the second scan is: a whole record, or a record's end, middle or beginning.
WHOLE, END, MIDDLE, BEGINNING = 0, 1, 2, 3

_FRAGMENTS = "file string, block long, kind int, first boolean, value string"


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open after ``line``, which begins inside one or at a record's start.

    A quote opens a field only as its first character; inside, two quotes are one character;
    what follows a closing quote, up to the separator, belongs to the field.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            while at < n and line[at] != QUOTE:
                at = line.find(sep, at) + len(sep)
                if at < len(sep):
                    return False
            if at >= n:
                return False
            at += 1
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1:at + 2] != QUOTE:
                break
            at += 2
        at = line.find(sep, at + 1) + len(sep)
        if at < len(sep):
            return False
        inside = False


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], np.ndarray]]:
    """(file, block, lines, positions of lines with a quote) of each batch's stretches of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch["block"].to_numpy(zero_copy_only=False)
        files = batch["file"].dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)], strict=True):
            lines = batch["value"].slice(a, b - a)
            quoted = np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False))
            yield files.dictionary[codes[a]].as_py(), int(blocks[a]), lines, quoted


def _transitions(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block, whether a quoted field is open at its end if none (``plain``) or one (``open``) was at its beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for file, block, lines, quoted in _stretches(batches):
            plain, opened = found.get((file, block), (False, True))
            for i in quoted:
                line = lines[i].as_py()
                same = plain == opened
                plain = ends_inside(line, plain, sep)
                opened = plain if same else ends_inside(line, opened, sep)
            found[file, block] = plain, opened
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([f for f, _ in found], pa.string()), "block": pa.array([b for _, b in found], pa.int64()),
            "plain": pa.array([p for p, _ in found.values()], pa.bool_()),
            "open": pa.array([o for _, o in found.values()], pa.bool_())})
    return run


def _records(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records of each block, its first and last one in part where they cross a border."""
    def rows(file: str, block: int, kind: int, first: list[bool], values: pa.Array) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
             pa.array(first, pa.bool_()), values.cast(pa.string())], names=["file", "block", "kind", "first", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An open record's lines; whether it began in this block; records of this block so far.
        at: tuple[str, int] | None = None
        held: list[str] = []
        inside = began = False
        seen = 0

        def last() -> Iterator[pa.RecordBatch]:
            if at is not None and inside:
                yield rows(*at, BEGINNING if began else MIDDLE, [began and seen == 0 and at[1] == 0], pa.array(["\n".join(held)]))

        for batch in batches:
            flags = batch["inside"].to_numpy(zero_copy_only=False)
            row = 0
            for file, block, lines, quoted in _stretches(iter([batch])):
                if (file, block) != at:
                    yield from last()
                    at, held, inside, began, seen = (file, block), [], bool(flags[row]), False, 0
                row += len(lines)
                pieces, done = [], 0  # whole records: stretches of lines, and joined ones
                for i in quoted:
                    line = lines[int(i)].as_py()
                    now = ends_inside(line, inside, sep)
                    if now and not inside:
                        pieces.append(lines.slice(done, i - done))
                        held, began, done = [], True, i
                    elif inside and not now:
                        held += lines.slice(done, i + 1 - done).to_pylist()
                        if began:
                            pieces.append(pa.array(["\n".join(held)], pa.string()))
                        else:
                            yield rows(file, block, END, [False], pa.array(["\n".join(held)], pa.string()))
                        held, done = [], i + 1
                    inside = now
                rest = lines.slice(done)
                if inside:
                    held += rest.to_pylist()
                else:
                    pieces.append(rest)
                whole = pa.concat_arrays([p.cast(pa.string()) for p in pieces]) if pieces else pa.array([], pa.string())
                whole = whole.filter(pc.invert(pc.is_in(whole, pa.array(["", "\r"]))))
                if len(whole):
                    yield rows(file, block, WHOLE, [block == 0 and seen + k == 0 for k in range(len(whole))], whole)
                    seen += len(whole)
        yield from last()
    return run


def record_texts(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """(value): one row for each record of the files at ``path``, in its raw form, blank lines and headers left out.

    Lines end in a line feed, or in a carriage return and one.  A file of one record that
    is never closed is one record to its end.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    blocks = lines.mapInArrow(_transitions(sep), "file string, block long, plain boolean, open boolean")
    # A block either keeps the case it begins in, turns it round, or ends in one whatever it began in.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("plain") & ~F.col("open"), 1).otherwise(0)).over(before), F.lit(0))
    fixed = F.when(F.col("plain") == F.col("open"), F.struct("plain", (F.col("turns")).alias("turns")))
    cases = (blocks.withColumn("turns", turns).withColumn("last", F.last(fixed, ignorenulls=True).over(before))
             .withColumn("odd", (F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
             .withColumn("inside", F.coalesce(F.col("last.plain"), F.lit(False)) != F.col("odd"))
             .withColumn("leaves", F.when(F.col("inside"), F.col("open")).otherwise(F.col("plain")))
             .where(F.col("inside") | F.col("leaves")).select("file", "block", "inside"))
    # One row at most for each block of a file, so a millionth of the input: sent to every task.
    known = F.broadcast(cases)

    def scan(how: str) -> DataFrame:
        met = lines.join(known, ["file", "block"], how).withColumn("inside", F.coalesce("inside", F.lit(False)))
        return met.select("value", "file", "block", "inside").mapInArrow(_records(sep), _FRAGMENTS)

    order = F.when(F.col("kind") == BEGINNING, 1).otherwise(0)
    upto = Window.partitionBy("file").orderBy("block", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == BEGINNING, F.col("block")), ignorenulls=True).over(upto)
    parts = F.array_sort(F.collect_list(F.struct("block", order.alias("order"), "value")))
    crossing = (scan("inner").where(F.col("kind") != WHOLE).withColumn("owner", owner).groupBy("file", "owner")
                .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.max("first").alias("first"))
                .select("value", "first"))
    texts = scan("left").where(F.col("kind") == WHOLE).select("value", "first").unionByName(crossing)
    if header:
        texts = texts.where(~F.col("first"))
    return texts.select(F.regexp_replace("value", "\r$", "").alias("value"))


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """The records of quoted CSV files, parsed with ``schema`` (one task for each block, not for each file)."""
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST", "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return record_texts(spark, path, header, sep).select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
