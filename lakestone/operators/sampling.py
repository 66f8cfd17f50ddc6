"""Exact-size hash sampling, global ranks and hash order, without a single-task bottleneck.

A sample of exactly ``n`` rows is "the n rows with the smallest (hash, key)".  Taking
``orderBy(hash).limit(n)`` would gather n rows in one task, and n grows with the data.
Instead the cutoff (hash, key) of the n-th row is found by refining a histogram of the
hash: each round is one grouped count with at most ``buckets`` rows (a bounded result),
until the bucket that holds the n-th row is small enough to order exactly.  Membership
is then a plain predicate ``(hash, key) <= cutoff`` on every executor.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_LIMIT = 1 << 60   # hash_score values are in [0, 2^60)


def rank_cutoffs(parts: dict, n, buckets: int = 4096, max_exact: int = 100_000) -> dict:
    """Cutoffs of several samples at once: ``parts`` maps a name to ``(df, score, key)``.

    ``n`` is one size for all, or a dict of sizes.  Every refinement round is one
    grouped count over all samples (at most ``buckets`` rows per sample come back), and
    one final job orders the boundary rows of every sample (at most ``max_exact`` rows
    per sample, or one hash value) with a window partitioned by sample.
    Returns name -> (score, key) of the n-th row, or None when n <= 0.  Fewer rows than
    asked for are all selected.
    """
    original_names = list(parts)
    sizes = n if isinstance(n, dict) else {name: n for name in parts}
    # Samples over the same DataFrame share one scan: all their scores in one projection.
    groups: dict = {}
    for name, (df, score, key) in parts.items():
        groups.setdefault(id(df), (df, []))[1].append((name, score, key))
    rows = None
    for df, members in groups.values():
        entries = [F.struct(F.lit(str(name)).alias("g"),
                            (F.col(score) if isinstance(score, str) else score).cast("long").alias("s"),
                            F.col(key).cast("long").alias("k")) for name, score, key in members]
        part = df.select(F.inline(F.array(*entries)))
        rows = part if rows is None else rows.unionByName(part)
    parts = {str(name): v for name, v in parts.items()}
    sizes = {str(name): v for name, v in sizes.items()}
    # Each sample refines a score range, and when one score value alone holds more than
    # ``max_exact`` rows (a hot value), a key range inside that value (keys are unique).
    state = {name: {"lo": 0, "hi": SCORE_LIMIT, "need": sizes[name], "phase": "s"} for name in parts}
    result: dict = {name: None for name in parts if sizes[name] <= 0}
    active = [name for name in parts if sizes[name] > 0]
    final: list = []
    KEY_LO, KEY_HI = -(1 << 63), 1 << 63

    def in_range(names):
        conds = []
        for nm in names:
            st = state[nm]
            c = (F.col("g") == F.lit(nm))
            if st["phase"] == "s":
                c = c & (F.col("s") >= F.lit(st["lo"])) & (F.col("s") < F.lit(st["hi"]))
            else:
                c = c & (F.col("s") == F.lit(st["s"])) & (F.col("k") >= F.lit(st["lo"]))
                if st["hi"] < KEY_HI:
                    c = c & (F.col("k") < F.lit(st["hi"]))
            conds.append(c)
        return reduce(operator.or_, conds)

    def bucket_sql(nm):
        st = state[nm]
        col = "s" if st["phase"] == "s" else "CAST(k AS DECIMAL(20,0))"
        return f"WHEN g = '{nm}' THEN CAST(({col} - {st['lo']}) div {st['width']} AS BIGINT)"

    while active:
        for nm in active:
            st = state[nm]
            st["width"] = max(1, -(-(st["hi"] - st["lo"]) // buckets))
        # Integer division: a double quotient could put a boundary row in the wrong bucket.
        bucket = F.expr("CASE " + " ".join(bucket_sql(nm) for nm in active) + " END")
        hist: dict = {nm: [] for nm in active}
        for r in rows.filter(in_range(active)).groupBy("g", bucket.alias("b")).agg(
                F.count(F.lit(1)).alias("c")).collect():
            hist[r.g].append((int(r.b), int(r.c)))
        still = []
        for nm in active:
            st, h = state[nm], sorted(hist[nm])
            total = sum(c for _, c in h)
            if total < st["need"]:
                # Fewer rows than asked: every row is selected.
                result[nm] = (SCORE_LIMIT, (1 << 63) - 1)
                continue
            acc = 0
            for b, c in h:
                if acc + c >= st["need"]:
                    break
                acc += c
            st["need"] -= acc
            st["lo"], st["hi"] = st["lo"] + b * st["width"], min(st["lo"] + (b + 1) * st["width"], st["hi"])
            if c <= max_exact:
                final.append(nm)
            elif st["phase"] == "s" and st["width"] == 1:
                # One hot score value: continue on the key inside it.
                st.update(phase="k", s=st["lo"], lo=KEY_LO, hi=KEY_HI)
                still.append(nm)
            else:
                still.append(nm)
        active = still
    if final:
        w = Window.partitionBy("g").orderBy("s", "k")
        wanted = reduce(operator.or_, [(F.col("g") == F.lit(nm)) & (F.col("__rn") == F.lit(state[nm]["need"]))
                                       for nm in final])
        for r in rows.filter(in_range(final)).withColumn("__rn", F.row_number().over(w)).filter(wanted).collect():
            result[r.g] = (int(r.s), int(r.k))
    return {name: result.get(str(name)) for name in original_names}


def rank_cutoff(df: DataFrame, score: str, key: str, n: int, buckets: int = 4096,
                max_exact: int = 100_000) -> tuple[int, int] | None:
    """(score, key) of the n-th smallest row, or None when n <= 0 (all rows if fewer)."""
    return rank_cutoffs({"x": (df, score, key)}, n, buckets, max_exact)["x"]


def at_or_below(score, key, cutoff: tuple[int, int] | None) -> Column:
    """Predicate: (score, key) <= cutoff in lexicographic order (FALSE when no cutoff)."""
    s = F.col(score) if isinstance(score, str) else score
    k = F.col(key) if isinstance(key, str) else key
    if cutoff is None:
        return F.lit(False)
    cs, ck = F.lit(cutoff[0]), F.lit(cutoff[1])
    return (s < cs) | ((s == cs) & (k <= ck))


#: Nodes whose counts one window task adds up.
FANOUT = 1024


def bucket_offsets(counts: DataFrame, n_buckets: int, fanout: int = FANOUT) -> DataFrame:
    """(``bucket``, ``offset``) of (``bucket``, ``n``): the sum of ``n`` over all smaller buckets.

    A tree of prefix sums: a node's offset is its parent's plus its smaller siblings' totals.
    No window holds more than ``fanout`` rows, and no number passes through the driver.
    """
    if n_buckets <= 1:
        return counts.select("bucket", F.lit(0).cast("long").alias("offset"))
    parent = F.expr(f"bucket div {fanout}")
    siblings = Window.partitionBy(parent).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.select("bucket", parent.alias("parent"), F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("local"))
    totals = counts.groupBy(parent.alias("bucket")).agg(F.sum("n").alias("n"))
    above = bucket_offsets(totals, -(-n_buckets // fanout), fanout)
    return (local.join(above.select(F.col("bucket").alias("parent"), "offset"), "parent")
            .select("bucket", (F.col("offset") + F.col("local")).cast("long").alias("offset")))


def rank_in_sample(df: DataFrame, score: str, key: str, cutoff: tuple[int, int] | None, n: int,
                   name: str = "rank", group_rows: int = 50_000) -> DataFrame:
    """(``key``, ``name``) of the sample ``(score, key) <= cutoff``: its 0-based rank in that order.

    Hash scores are uniform, so ``n / group_rows`` fixed-width score buckets hold about
    ``group_rows`` rows each at any sample size.  The rank is the bucket's offset (see
    ``bucket_offsets``) plus ``row_number()`` inside the bucket; both are partitioned by the
    bucket, so offsets meet rows without another shuffle.  Only score and key move: join the
    rank back by the key.
    """
    pairs = df.select(score, key)
    if cutoff is None:
        return pairs.limit(0).select(key, F.lit(0).cast("long").alias(name))
    buckets = max(1, -(-n // group_rows))
    width = cutoff[0] // buckets + 1
    sample = (pairs.filter(at_or_below(score, key, cutoff))
              .withColumn("__b", F.expr(f"`{score}` div {width}")))
    w = Window.partitionBy("__b").orderBy(score, key)
    placed = sample.withColumn("__place", (F.row_number().over(w) - F.lit(1)).cast("long"))
    if buckets == 1:
        return placed.select(key, F.col("__place").alias(name))
    counts = sample.groupBy(F.col("__b").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(counts, buckets).select(F.col("bucket").alias("__b"), "offset")
    return placed.join(offsets, "__b").select(key, (F.col("offset") + F.col("__place")).alias(name))


def hash_order(df: DataFrame, score: Column) -> DataFrame:
    """Rows in a pseudo-random but reproducible order (for file output only)."""
    return df.withColumn("__order", score).orderBy("__order").drop("__order")
