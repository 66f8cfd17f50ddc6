"""Merkle manifest of a table: one tree a source, a tree over the sources, and every row's proof.

Leaves are numbered inside their source by ``prefix.laid`` and dealt into superblocks of
``FANOUT ** HEIGHT`` neighbours.  Going up, each superblock is reduced to one node, and the
nodes are the leaves of the next round.  Going down, the nodes of a superblock are cogrouped
with the one row that holds what lies outside: the siblings on the way from the superblock to
the root.  The cogroup ends the local reduction, joins both parts of every proof and folds the
presented leaf with it.  A task holds one superblock, whatever the source's size; the outer
row grows with the tree's height.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.session import scratch_path

from .prefix import laid

FANOUT, HEIGHT = 3, 7
SIZE = FANOUT ** HEIGHT

_PROOF = "left array<string>, right array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row (lowercase hex)."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def reduced(nodes: list[str], first: bool) -> list[list[str]]:
    """All levels of a superblock, its nodes first.

    The first superblock of a tree ends when one node is left; a later one has siblings of
    its own at each level, so a single node is digested on, too.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 if first else len(levels) <= HEIGHT:
        row = levels[-1]
        levels.append([digest("".join(row[i:i + FANOUT])) for i in range(0, len(row), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """Per level the digests left and right of the node's run, joined."""
    left, right = [], []
    for row in levels[:-1]:
        low = at - at % FANOUT
        left.append("".join(row[low:at]))
        right.append("".join(row[at + 1:low + FANOUT]))
        at //= FANOUT
    return left, right


def fold(presented: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and the siblings of its proof give."""
    for a, b in zip(left, right, strict=True):
        presented = digest(a + presented + b)
    return presented


def _up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    nodes = [d for d, n in zip(rows["digest"], rows["copies"], strict=True) for _ in range(n)]
    return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "digest": [reduced(nodes, key[1] == 0)[-1][0]]})


def _nodes_down(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    levels = reduced(list(rows["digest"]), key[1] == 0)
    up_left, up_right = list(outer["left"].iloc[0]), list(outer["right"].iloc[0])
    paths = [siblings(levels, i) for i in range(len(rows))]
    return pd.DataFrame({"tree": key[0], "at": rows["at"], "root": outer["root"].iloc[0],
                         "left": [a + up_left for a, _ in paths], "right": [b + up_right for _, b in paths]})


def _leaves_down(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    rows = rows.loc[rows.index.repeat(rows["copies"])]
    nodes = list(rows["digest"])
    levels = reduced(nodes, key[1] == 0)
    up_left, up_right = list(outer["left"].iloc[0]), list(outer["right"].iloc[0])
    paths = [siblings(levels, i) for i in range(len(nodes))]
    left, right = [a + up_left for a, _ in paths], [b + up_right for _, b in paths]
    shown = [p if isinstance(p, str) else d for p, d in zip(rows["presented"], nodes, strict=True)]
    return pd.DataFrame({"id": rows["id"], "leaf": nodes, "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
                         "left": left, "right": right,
                         "folded_root": [fold(p, a, b) for p, a, b in zip(shown, left, right, strict=True)]})


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _block(at: str) -> Column:
    return F.expr(f"{at} div {SIZE}").alias("block")


def _reduce(nodes: DataFrame) -> DataFrame:
    """The superblocks' own nodes: (tree, at, digest)."""
    return _kept(nodes.groupBy("tree", "block").applyInPandas(_up, "tree string, at long, digest string"), "merkle")


def _paths(nodes: DataFrame, span: int) -> DataFrame:
    """(tree, at, root, left, right) of (tree, at, digest): each node's way to the last node of its tree.

    ``span`` is the largest number of nodes of a tree.
    """
    if span <= 1:
        none = F.array().cast("array<string>")
        return nodes.select("tree", "at", F.col("digest").alias("root"), none.alias("left"), none.alias("right"))
    blocks = nodes.select("tree", "at", "digest", F.lit(1).cast("long").alias("copies"), _block("at"))
    outer = _paths(_reduce(blocks), -(-span // SIZE))
    found = (blocks.select("tree", "at", "digest", "block").groupBy("tree", "block").cogroup(outer.groupBy("tree", "at"))
             .applyInPandas(_nodes_down, f"tree string, at long, root string, {_PROOF}"))
    return _kept(found, "merkle-paths")


def manifest(docs: DataFrame, digests: Column, presented: Column | None = None, group: str = "source",
             key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, left, right, folded_root) of every row.

    ``digests`` is a row's leaf (see :func:`leaf`); inside a ``group`` leaves ascend by ``key``
    (nulls first, equal keys by leaf), groups ascend bytewise, a null group first.  ``left`` and
    ``right`` hold, level by level from the leaf to the root, the run's other digests.
    ``folded_root`` is what ``presented`` (null: the leaf itself) gives with these siblings: the
    root, unless the row was changed.  Repeated rows are leaves of their own.  A group of one
    row has that leaf as subroot, a table of one group its subroot as root, an empty table no
    rows.  Other columns are not carried, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.unhex(digests).alias("_leaf"),
                       F.unhex(F.lit(None).cast("string") if presented is None else presented).alias("_presented"))
    runs = laid(rows, ["_group"], ["_key", "_leaf", "_presented"])
    span = runs.agg(F.max(F.col("_start") + F.col("_copies"))).first()[0] or 0
    # A run of copies is cut at superblock borders; the cogroup writes its copies out.
    cut = (runs.withColumn("block", F.explode(F.expr(f"sequence(_start div {SIZE}, (_start + _copies - 1) div {SIZE})")))
           .withColumn("at", F.greatest(F.col("_start"), F.col("block") * SIZE))
           .withColumn("copies", F.least(F.col("_start") + F.col("_copies"), (F.col("block") + 1) * SIZE) - F.col("at")))
    leaves = cut.select(field(F.col("_group")).alias("tree"), "block", "at", "copies", F.col("_key").alias("id"),
                        F.lower(F.hex("_leaf")).alias("digest"), F.lower(F.hex("_presented")).alias("presented"))
    own = _paths(_reduce(leaves.select("tree", "block", "at", "copies", "digest")), -(-span // SIZE))
    # The subroots are the leaves of one more tree.
    groups = laid(docs.select(F.col(group).alias("_group")).distinct(), [], ["_group"])
    tops = (groups.select(field(F.col("_group")).alias("tree"), F.col("_start").alias("_at"))
            .join(own.where("at = 0").select("tree", "root"), "tree"))
    tops = _kept(tops.select("tree", F.col("_at").alias("at"), F.col("root").alias("digest")), "merkle-tops")
    whole = _paths(tops.select(F.lit("").alias("tree"), "at", "digest"), tops.count())
    above = tops.join(whole.select(F.col("at").alias("_at"), F.col("root").alias("top"), F.col("left").alias("top_left"),
                                   F.col("right").alias("top_right")), F.col("at") == F.col("_at"))
    outer = (own.join(above.select("tree", "top", "top_left", "top_right"), "tree")
             .select("tree", "at", F.col("root").alias("subroot"), F.col("top").alias("root"),
                     F.concat("left", "top_left").alias("left"), F.concat("right", "top_right").alias("right")))
    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    out = (leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "at"))
           .applyInPandas(_leaves_down, f"id {kind}, leaf string, subroot string, root string, {_PROOF}, folded_root string"))
    return out.withColumnRenamed("id", key)


def proof_digest(left: str = "left", right: str = "right") -> Column:
    """Digest of all siblings of a proof, in the order of the folding."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)
