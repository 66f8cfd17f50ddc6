"""Bottom-k document fingerprints: the k smallest hashes of a text's distinct shingles.

Sketches merge by keeping the k smallest of both, so a text, a file or a table can be
sketched in parts.  Two sketches estimate resemblance (shared among the k smallest of the
union), containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .textops import U64, Words, pieces, shingles

K = 128
SHINGLE = 5


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 8 * k:
        part = np.partition(hashes, 4 * k - 1)[:4 * k]
        small = np.unique(part)
        if len(small) >= k:
            return small[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if only one is empty."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(U64)


def sketches(texts: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text; null and wordless texts have the empty one."""
    out = []
    for _, _, data, offsets in pieces(texts):
        hashes, first = shingles(Words(data, offsets), size)
        out += [sketch(hashes[first[i]:first[i + 1]], k) for i in range(len(offsets) - 1)]
    return out


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``fingerprint`` (base64 of big-endian hashes, ascending).

    Null and empty texts give the empty string; equal texts equal fingerprints; every row
    stays; a column of that name is replaced.
    """
    docs = docs.drop("fingerprint")
    schema = StructType([*docs.schema.fields, StructField("fingerprint", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [encode(s) for s in sketches(b.column(names.index(text)), k, size)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.string())], names=[*names, "fingerprint"])

    names = docs.columns
    return docs.mapInArrow(run, schema)


_EDIT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, n_shingles double, contained double")


def _edited(k: int, size: int):
    def rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        own = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following, strict=True)]
        a, b = sketches(pa.array(texts), k, size), sketches(pa.array(own), k, size)
        c = sketches(pa.array(following), k, size)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in own]),
            pa.array([encode(x) for x in a]), pa.array([encode(x) for x in b]),
            pa.array([resemblance(x, y, k) for x, y in zip(a, b, strict=True)]),
            pa.array([resemblance(x, y, k) for x, y in zip(a, c, strict=True)]),
            pa.array([distinct(x, k) for x in a]),
            pa.array([containment(x, y, k) for x, y in zip(a, b, strict=True)])],
            names=[f.split()[0] for f in _EDIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last own row, which waits for the text after it
        ids: list = []
        texts: list[str] = []
        nexts: list[str] = []
        load = 0
        for batch in batches:
            for part, doc, text, tail in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                text = text or ""
                if held is not None and held[0] == part:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(text)
                    load += len(held[2])
                held = None if tail else (part, doc, text)
                if load > 1 << 20:
                    yield rows(ids, texts, nexts)
                    ids, texts, nexts, load = [], [], [], 0
        if ids:
            yield rows(ids, texts, nexts)

    return run


def _bounds(rows: DataFrame, ranges: int, top: int | None) -> np.ndarray:
    """Ascending ids of the table, ``top`` last, that cut it into about ``ranges`` ranges."""
    if top is None:
        return np.array([-(1 << 63)], np.int64)
    ids = rows.filter(F.col("doc_id").isNotNull()).select("doc_id")
    cuts = ids.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    found = {int(c) for c in cuts}
    if any(abs(c) >= 1 << 53 for c in found):  # quantiles come back as doubles: the smallest id from each on stands for it
        at = np.array(sorted(c for c in found if c < 1 << 63), np.int64)

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.sort(b.column(0).to_numpy())
                cell = np.searchsorted(at, x, "right")
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell[first], pa.int64()), pa.array(x[first], pa.int64())], names=["cell", "id"])

        found = {r["id"] for r in ids.mapInArrow(least, "cell long, id long").groupBy("cell").agg(F.min("id").alias("id")).collect()}
    return np.array(sorted({c for c in found if c < top} | {top}), np.int64)


def compare_edited(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprint of every text and of its edited text: the last half of its code points
    replaced by the first as many of the next document's, by descending doc_id (after the
    last comes the first; a lone document follows itself).

    Null texts are empty; equal ids are ordered by text, null ids come last; every row
    gives a row; an empty table gives none.  The ids are cut into ranges at approximate
    quantiles, four for each shuffle partition.  A cut is an id of the table, so the head
    of each range is known by its id: it is also sent, as a tail, to the range before it,
    and the texts are moved once.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    top = rows.agg(F.max("doc_id")).first()[0]
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, ranges, top)
    last = len(bounds) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(lowest).to_numpy()
            at = np.searchsorted(bounds, ids, "left")
            part, heads = last - at, np.flatnonzero(bounds[at] == ids)
            before = np.where(part[heads] > 0, part[heads] - 1, last)
            take = pa.array(np.concatenate((np.arange(len(ids)), heads)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((part, before)).astype(np.int32)), b.column(0).take(take), b.column(1).take(take),
                pa.array(np.arange(len(ids) + len(heads)) >= len(ids))], names=["part", "doc_id", "text", "tail"])

    dealt = rows.mapInArrow(deal, "part int, doc_id long, text string, tail boolean")
    ordered = dealt.repartition(ranges // 4, "part").sortWithinPartitions(
        "part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_edited(k, size), _EDIT)
