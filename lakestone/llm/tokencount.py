"""Token counts of flat token files by a separator scan.

A token file is nothing but little-endian ids; an end-of-document id closes each document
and there is no index.  Files are read in blocks.  Each block finds its separators with one
vectorised comparison; a prefix scan over the blocks of a file carries the position of the
last separator and the number of documents before, so a document that spans blocks, also
many, gets its whole count.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestone.session import scratch_path

#: Bytes of a block.
BLOCK = 1 << 22
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A store that every executor reaches, from a full URI or an absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def bpe_encoder(vocabulary: str = VOCABULARY, pattern: str | None = None) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A factory, run once a task, of a function from texts to ids of a public byte-level BPE."""
    def make() -> Callable[[list[str]], list[list[int]]]:
        import tiktoken
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        split = pattern or r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        coder = tiktoken.Encoding("flat", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    return make


_MANIFEST = "path string, ordinal long, doc_id long"


def write_token_files(docs: DataFrame, folder: str, encoder: Callable, end_id: int, width: int = 2) -> DataFrame:
    """Writes one token file for each input partition and returns its manifest (path, ordinal, doc_id).

    Every attempt of a task writes a file of its own name, and only the names in the
    manifest count, so a retried task leaves at most an unread file.  Null texts have no
    tokens; every row is a document.  The manifest must be written before it is used twice.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sink, ordinal, path = encoder(), None, 0, f"{folder}/{uuid.uuid4().hex}.bin"
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            if sink is None:
                store, place = _open(path)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(place)
            for at in range(0, len(texts), 256):
                for tokens in encode([t or "" for t in texts[at:at + 256]]):
                    sink.write(np.append(np.asarray(tokens, np.int64), end_id).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(np.arange(ordinal, ordinal + len(ids))), ids],
                                             names=["path", "ordinal", "doc_id"])
            ordinal += len(ids)
        if sink is not None:
            sink.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MANIFEST)


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document in the token files named in ``files.path``.

    ``start`` is the document's first token in its file.  Tokens after the last separator
    form a last document without one; an empty file has none; a document may be empty.  A
    file whose size isn't a whole number of ids raises.
    """
    kind = np.dtype({2: "<u2", 4: "<u4"}[width])
    step = block - block % width

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                store, place = _open(path)
                size = store.get_file_info(place).size
                if size is None or size % width:
                    raise ValueError(f"{path}: not a whole number of {width}-byte ids")
                found.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["path", "size"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, place = _open(path)
                with store.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(min(step, size - at), at), kind)
                ends = np.flatnonzero(ids == end_id) + at // width
                if at + step >= size and ids[-1] != end_id:
                    ends = np.append(ends, size // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([at], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    names=["path", "at", "ends"])

    sized = files.select("path").distinct().mapInArrow(sizes, "path string, size long").filter("size > 0")
    blocks = sized.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at"), "size")
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(spread, "path", "at").mapInArrow(scan, "path string, at long, ends array<long>")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (found.withColumn("last", F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before),
                                                    F.lit(-1).cast("long")))
                .withColumn("docs", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0).cast("long"))))
    each = stitched.select("path", "docs", "last", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("last")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1)))) + 1
    return each.select("path", (F.col("docs") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("end") - start).alias("n_tokens"))


def document_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 50256, width: int = 2,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, path, ordinal, start, n_tokens): writes the token files of ``docs`` to the shared folder and counts them."""
    spark: SparkSession = docs.sparkSession
    folder, manifest = scratch_path(spark, "tokens"), scratch_path(spark, "token-manifest")
    write_token_files(docs, folder, bpe_encoder(vocabulary), end_id, width).write.parquet(manifest)
    listed = spark.read.schema(_MANIFEST).parquet(manifest)
    counted = count_tokens(listed, end_id, width, block)
    # The manifest's file is far smaller than its rows, so Spark would take it for one to broadcast.
    return listed.hint("merge").join(counted, ["path", "ordinal"]).select("doc_id", "path", "ordinal", "start", "n_tokens")
