"""Near-duplicates by BagMinHash signatures, banding and exact multiset verification.

A document is the bag of its five-word shingles, a shingle's weight its number of
occurrences.  Every shingle drives a Poisson process over time, registers and weight
levels.  The levels are discretised into unit cells that form a dyadic hierarchy: blocks
[0, 1), [1, 2), [2, 4), [4, 8) ... have processes of their own, with a rate in proportion to
their width, and a point descends within its block by the bits of its draw to one cell.  A
document of weight w sees the points in cells below w, so heavier bags see a superset of
lighter ones.  A register keeps its earliest point; two bags agree in a register with
probability sum(min) / sum(max), their weighted Jaccard similarity.  Points arrive in order,
and a document's first (ln registers + 3) / weight of time nearly always fills all registers,
so a signature costs the same for long texts as for short ones beyond one draw a shingle.

Registers are banded.  Documents that share a band are compared with the smallest and the
largest text id of the band, exactly, on their shingle bags; in bands of more than two also
with one drawn from the texts that share the next band, or the next two, with them.  Links make classes by
connected components.  What that leaves in different components of one band is then compared
pair by pair, in squares of ``GROUP`` texts, and the components are made anew: texts of one
component need no comparison, so no link between classes is lost among texts that share a band.
Copies of a text are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestone.session import scratch_path

from .components import components
from .textops import U64, Words, mix, pieces, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
#: Bands that the longest runs of registers in crowded bands consist of.
FINER = 3
#: Members that one verification group holds besides its leader.
GROUP = 256


def bags(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, ordered by text and shingle."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Registers of each text: the earliest point's time (leading bits) and identity (trailing bits).

    A text without shingles has none set (all ones).
    """
    out = np.full((texts, registers), ~U64(0))
    total = np.bincount(text, weights=weight, minlength=texts)
    span, todo = np.log(registers) + 3.0, total > 0
    while todo.any():
        until = np.divide(span, total, out=np.zeros(texts), where=total > 0)
        own = np.flatnonzero(todo[text])
        # Blocks of each shingle: block 0 is the cell 0, block j > 0 the cells from 2**(j-1) to 2**j - 1.
        blocks = 1 + np.ceil(np.log2(weight[own])).astype(np.int64)
        own = np.repeat(own, blocks)
        block = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
        width = np.maximum(low, 1).astype(np.float64)
        with np.errstate(over="ignore"):
            state = mix(shingle[own] + block.astype(U64) * U64(0x9E3779B97F4A7C15))
            doc, time, limit = text[own], np.zeros(len(own)), until[text[own]]
            below = weight[own]
            while len(doc):
                state = mix(state + U64(0xA0761D6478BD642F))
                time = time - np.log1p(-_uniform(state)) / (width * registers)
                on = time <= limit
                doc, state, time, limit, low, width, below = (x[on] for x in (doc, state, time, limit, low, width, below))
                place = mix(state ^ U64(0xE7037ED1A0B428DB))
                cell = low + ((place >> U64(32)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
                seen = np.flatnonzero(cell < below)
                at = doc[seen] * registers + ((place[seen] & U64(0xFFFFFFFF)) % U64(registers)).astype(np.int64)
                value = (time[seen].view(U64) & ~U64(0xFFFFF)) | (mix(place[seen]) & U64(0xFFFFF))
                np.minimum.at(out.reshape(-1), at, value)
        todo &= (out == ~U64(0)).any(1)
        span *= 2
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard similarity of two bags (distinct shingles, weights); two empty bags are alike."""
    sa, sb = int(a[1].sum()), int(b[1].sum())
    if not sa or not sb:
        return float(sa == sb)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (sa + sb - both)


def _signed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(2)):
                hashes, first = shingles(Words(data, offsets), shingle)
                registers = signatures(*bags(hashes, first), len(first) - 1, bands * rows)
                keys = np.zeros((len(registers), bands), U64)
                with np.errstate(over="ignore"):
                    keys += np.arange(bands, dtype=U64) + U64(1)
                    for r in range(rows):
                        keys = mix(keys * U64(0xD6E8FEB86659FD93) + registers[:, r::rows])
                size = np.diff(first)
                at = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(keys[size > 0].reshape(-1).view(np.int64)))],
                    names=["node", "doc_id", "size", "bands"])
    return run


def _verified(shingle: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        leader = table["leader"][0].as_py()
        nodes = table["node"].to_numpy()
        found: list[tuple[int, int, float]] = []
        head = None
        order = np.argsort(nodes != leader, kind="stable")  # the leader first
        column = table["text"].combine_chunks().take(pa.array(order))
        for lo, hi, data, offsets in pieces(column):
            hashes, first = shingles(Words(data, offsets), shingle)
            text, h, w = bags(hashes, first)
            cuts = np.searchsorted(text, np.arange(len(first)))
            for i in range(hi - lo):
                bag, node = (h[cuts[i]:cuts[i + 1]], w[cuts[i]:cuts[i + 1]]), int(nodes[order[lo + i]])
                if head is None:
                    head = bag
                elif (s := similarity(head, bag)) >= least and node != leader:
                    found.append((node, leader, s))
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
    return run


def _across(shingle: int, least: float):
    """Links between the two sides of a square (``side`` 0 and 1; on the diagonal, 2 is both) whose components differ."""
    def run(table: pa.Table) -> pa.Table:
        nodes, side, label = (table[c].to_numpy() for c in ("node", "side", "component"))
        found: list[tuple[int, int, float]] = []
        known: list = [None] * len(nodes)
        for lo, hi, data, offsets in pieces(table["text"].combine_chunks()):
            hashes, first = shingles(Words(data, offsets), shingle)
            text, h, w = bags(hashes, first)
            cuts = np.searchsorted(text, np.arange(len(first)))
            known[lo:hi] = [(h[cuts[i]:cuts[i + 1]], w[cuts[i]:cuts[i + 1]]) for i in range(hi - lo)]
        size = np.asarray([int(x[1].sum()) for x in known])
        # Within the task, texts that a link joins are of one component.
        parent = {int(x): int(x) for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in np.flatnonzero(side != 1).tolist():
            other = np.flatnonzero((side == 1) if side[i] == 0 else (side == 2) & (np.arange(len(nodes)) > i))
            fits = np.minimum(size[other], size[i]) >= least * np.maximum(size[other], size[i])
            for j in other[fits].tolist():
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y and (s := similarity(known[i], known[j])) >= least:
                    parent[x] = y
                    found.append((int(nodes[i]), int(nodes[j]), s))
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
    return run


def _left_over(members: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links between texts that share a band and that ``found`` leaves in different components.

    In each band the texts are dealt into cells of about GROUP; each pair of cells is a group,
    where a pair of one component is passed over.  The band's largest component is not
    compared with itself, so that a large group with few others around costs little.
    """
    spark = members.sparkSession
    labels = components(found)
    in_band = _kept(members.select("key", "node").join(labels, F.col("node") == F.col("id"), "left")
                    .select("key", "node", F.coalesce("component", "node").alias("component")), "left")
    parts = in_band.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = (parts.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main"))
             .filter(F.col("all") > F.col("main.size"))
             .select(F.col("key").alias("_key"), F.col("main.component").alias("main"), F.ceil(F.col("main.size") / GROUP).alias("mains"),
                     F.ceil((F.col("all") - F.col("main.size")) / GROUP).alias("rests")))
    # The same texts often meet in several bands: a band of the same members is compared once.
    open_ = _kept(in_band.join(mixed, F.col("key") == F.col("_key")).select("key", "node", "component", "main", "mains", "rests"), "open")
    same = (open_.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("size"),
                                     F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark"))
            .groupBy("sum", "size", "mark").agg(F.min("key").alias("_key")))
    once = open_.join(same.select("_key"), F.col("key") == F.col("_key")).drop("_key")
    # The largest component's cells come after the rest's, and only meet those.
    in_main = F.col("component") == F.col("main")
    cell = once.withColumn("cell", F.when(in_main, F.col("rests") + F.pmod(F.xxhash64("node"), F.col("mains")))
                           .otherwise(F.pmod(F.xxhash64("node"), F.col("rests"))))
    last = F.col("rests") - 1 + F.when(in_main, F.lit(0)).otherwise(F.col("mains"))
    square = cell.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "key", "node", "component", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"),
        F.when(F.col("cell") == F.col("other"), 2).when(F.col("cell") < F.col("other"), 0).otherwise(1).alias("side"))
    carried = square.join(texts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    return _kept(carried.groupBy("key", "x", "y").applyInArrow(_across(shingle, least), "a long, b long, similarity double"), "across")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS,
          rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): ``nodes`` has (node, doc_id, size) for every row of ``docs``, ``links`` the
    verified pairs (a, b, similarity) of different texts."""
    base = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    signed = _kept(base.mapInArrow(_signed(shingle, bands, rows), "node long, doc_id long, size long, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"))
    ring = F.transform(F.sequence(F.lit(0), F.size("bands") - 1), lambda i: F.struct(
        *[F.get("bands", (i + j) % F.size("bands")).alias(f"key{j}") for j in range(FINER)]))
    banded = _kept(nodes.filter(F.size("bands") > 0).select("node", F.inline(ring)), "bands")
    shared = (banded.groupBy(F.col("key0").alias("key"))
              .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members"))
              .filter("low < high"))
    members = _kept(banded.join(shared, F.col("key0") == F.col("key")), "members")
    # In a crowded band, also by longer runs of registers: their groups are closer, so are their leaders.
    finer = members.filter("members > 2").select("node", F.explode(F.array(
        *[F.xxhash64(*[f"key{i}" for i in range(j + 1)]) for j in range(1, FINER)])).alias("fine"))
    # Their leaders are drawn anew for each run, so that a text meets many different ones.
    leads = (finer.withColumn("draw", F.xxhash64("fine", "node")).groupBy(F.col("fine").alias("_fine"))
             .agg(F.min_by("node", "draw").alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    near = finer.join(leads, F.col("fine") == F.col("_fine")).select("node", "leader")
    ends = members.select("node", F.explode(F.array("low", "high")).alias("leader"))
    pairs = (ends.unionByName(near).filter("node <> leader")
             .select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y"), "node", "leader")
             .groupBy("x", "y").agg(F.min("leader").alias("leader"))
             .select("leader", F.when(F.col("leader") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("node")))
    pairs = _kept(pairs, "pairs")
    # Written, so that the join deals both sides anew and can split a leader of many members.
    groups = _kept(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")), "groups")
    members = pairs.join(groups, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("groups")).alias("group"), "node")
    heads = groups.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"),
                          F.col("leader").alias("node"))
    firsts = signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    wanted = members.unionByName(heads).join(firsts, "node")
    carried = (base.join(wanted.withColumnsRenamed({"node": "_node"}),
                         (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
               .select("leader", "group", "node", "text").dropDuplicates(["leader", "group", "node"]))
    verified = carried.groupBy("leader", "group").applyInArrow(_verified(shingle, least), "a long, b long, similarity double")
    found = _kept(verified, "links")
    texts = (base.join(firsts.withColumnsRenamed({"node": "_node"}), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
             .select("node", "text").dropDuplicates(["node"]))
    shared_bands = banded.join(shared.filter("members > 2"), F.col("key0") == F.col("key")).select("key", "node")
    more = _left_over(shared_bands, found, texts, shingle, least)
    return signed.select("node", "doc_id", "size"), found.unionByName(more)


def classes(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, node, class_id, class_size, n_links, n_shingles) for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``class_size`` its rows, ``n_links``
    the verified links of the row's text to other texts, as many as join the class, not all.  Equal texts are one class; a text
    of fewer than five words is one shingle; wordless texts are alike only if equal, null
    counts as empty; null ids are no class id unless the class has no other.
    """
    nodes, found = links(docs, **kw)
    degree = (found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links")))
    linked = components(found).join(degree, "id")
    per_text = nodes.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    labelled = _kept(per_text.join(linked, F.col("node") == F.col("id"), "left")
                     .select("node", "first_doc", "copies", F.coalesce("component", "node").alias("component"),
                             F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    whole = labelled.groupBy("component").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"))
    known = labelled.join(whole, "component").select(F.col("node").alias("_node"), "class_id", "class_size", "n_links")
    return nodes.join(known, F.col("node") == F.col("_node")).select(
        "doc_id", "node", "class_id", "class_size", "n_links", F.col("size").alias("n_shingles"))


def deduplicate(docs: DataFrame, **kw) -> DataFrame:
    """One row of each class: the one with the smallest doc_id, columns unchanged.

    Rows equal in id and text are one; a class without ids keeps one row of its smallest
    text.  Null and empty texts are one class.
    """
    found = _kept(classes(docs, **kw).groupBy("node", "doc_id", "class_id", "class_size").agg(F.count(F.lit(1)).alias("times")), "kept")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # A doc_id that stands for two texts of one class, or a class without ids: its smallest text stays.
    chosen = (chosen.groupBy("doc_id", "class_id", "class_size", F.when(F.col("doc_id").isNull(), F.col("node")).alias("own"))
              .agg(F.min(F.struct("node", "times")).alias("best"))
              .select(F.col("doc_id").alias("_doc"), F.col("best.node").alias("_node"), F.col("best.times").alias("_times")))
    names = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = (F.col("_key") == F.col("_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))
    rows = keyed.join(chosen, on)
    if chosen.filter("_times > 1").isEmpty():
        return rows.select(*[F.col(f"`{c}`") for c in names])
    once, repeated = rows.filter("_times = 1"), rows.filter("_times > 1").dropDuplicates(["_key", "_doc"])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in names])
