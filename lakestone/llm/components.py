"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestone.session import scratch_path


#: Links that one task thins out.
FOREST_LINKS = 1 << 16


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: of each of its components, every member with the smallest.

    That joins the same members by at most one link each, and by short ways.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    alone: set[int] = set()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
            elif a == b:
                alone.add(a)
    found = [(x, root(x)) for x in list(parent)]
    found = [(x, r) for x, r in found if x != r or x in alone]
    for at in range(0, len(found), 1 << 16):
        a, b = zip(*found[at:at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b: long); the component is its smallest id.

    Links are dealt to tasks of ``FOREST_LINKS``, which turn theirs into stars, so that what
    follows grows with the members of a group rather than with its links.  Each round takes the smallest label among neighbours and then the label of that label,
    so the rounds needed grow with the logarithm of the longest chain.  Labels are written
    to the shared folder after every round, which cuts the lineage and survives lost
    executors.  No links give an empty table.
    """
    spark = links.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    tasks = -(-max(1, edges.count()) // FOREST_LINKS)
    forest = kept(edges.repartition(tasks).mapInArrow(_forest, "a long, b long"), "forest")
    both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        far = labels.select(F.col("id").alias("now"), F.col("component").alias("far"))
        stepped = kept(lower.join(far, "now").select("id", "was", F.least("now", "far").alias("component")), "labels")
        labels = stepped.select("id", "component")
        if stepped.filter("was <> component").isEmpty():
            return labels
