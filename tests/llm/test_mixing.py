import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import hard_rows, sentence
from pyspark.sql import functions as F

from lakestone.llm import mixing as X

SCHEMA = "doc_id long, source string, text string, name string, size string, block int, start int, words array<int>"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "s", 1, 2, [3]) for r in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 11}", sentence(rng, rng.randrange(0, 90))) for i in range(200)]
    rows += [(i, None, sentence(rng, 50)) for i in range(700, 720)] + [(9000, "long", sentence(rng, 3_000))]
    rows += [(800, "copies", "a b c")] * 50 + [(801, "copies", "")] * 7 + [(802, "copies", None)] * 3
    return rows + [(None, "s1", "x y"), (None, "s1", None), (3, "tiny", "one"), (4, "empty", " \n ")]


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set()
    while total > 1e-9:
        free = [s for s in order if s not in full]
        each = total / sum(weight[s] for s in free)
        total = 0.0
        for s in free:
            target[s] += weight[s] * each
            if target[s] > cap * sizes[s]:
                total += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                full.add(s)
    return target


def sizes_of(rows):
    out = Counter()
    for _, s, t in rows:
        out[s] += len((t or "").split())
    return out


def run(spark, rows, **how):
    docs = table(spark, rows)
    mixed = X.mix(docs, **how)
    return docs, mixed, X.taken(mixed).collect(), mixed.spans.collect()


@pytest.mark.parametrize("block", [3, 64])
def test_targets_are_met_and_no_document_is_taken_too_often(spark, block):
    rows = corpus()
    _, mixed, taken, spans = run(spark, rows, block_words=block, shard_blocks=16)
    sizes = sizes_of(rows)
    want = {X_field(s): t for s, t in water(sizes).items()}
    got = {r.source: r for r in mixed.sources.collect()}
    assert {s: r.size for s, r in got.items()} == {X_field(s): n for s, n in sizes.items()}
    assert all(abs(got[s].target - t) < 1e-6 for s, t in want.items())
    assert sorted((r.doc_id or -1, r.size) for r in taken) == sorted((i or -1, len((t or "").split())) for i, _, t in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    sums = Counter()
    for r in taken:
        sums[r.source] += r.taken
    assert all(abs(sums[s] - t) < 0.51 for s, t in want.items())
    # Every pass takes a block once, and blocks of one slot stand in one shard.
    slots = defaultdict(set)
    for r in spans:
        slots[r.source, r["pass"], r.block].add((r.shard, r.place))
    assert all(len(v) == 1 for v in slots.values())
    filled = Counter()
    for r in spans:
        filled[r.shard, r.place, r.source] += r.n_words
    assert max(filled.values()) <= block


def X_field(s):
    return "-" if s is None else f"{len(s.encode())}:{s}"


def test_spans_hold_the_words_they_name(spark):
    rows = [(i, s, t) for i, s, t in corpus() if i is not None]
    docs, mixed, _, spans = run(spark, rows, block_words=16, shard_blocks=64)
    text = {(r[0], X_field(r[1])): r[2].split() for r in rows if r[2]}
    want = defaultdict(list)
    for r in sorted(spans, key=lambda r: r.start):
        want[r.shard, r.place, r.source, r["pass"], r.block] += text[r.doc_id, r.source][r.first_word:r.first_word + r.n_words]
    got = {(r.shard, r.place, r.source, r["pass"], r.block): r.text.split() for r in X.contents(docs, mixed).collect()}
    assert got == dict(want)


def test_reruns_and_partitions_agree(spark):
    rows = corpus()
    first = sorted(map(tuple, run(spark, rows)[3]), key=repr)
    random.Random(9).shuffle(rows)
    mixed = X.mix(table(spark, rows).repartition(9))
    assert sorted(map(tuple, mixed.spans.collect()), key=repr) == first
    assert sorted(map(tuple, X.mix(table(spark, rows), seed=8).spans.collect()), key=repr) != first


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000, 4097])
def test_permutation_is_one(n):
    got = X.permute(np.arange(n), n, 12345)
    assert sorted(got) == list(range(n))
    assert n < 100 or np.mean(np.abs(np.diff(got)) == 1) < 0.05


@pytest.mark.parametrize("shards", [1, 64, 65, 200, 1000])
def test_chunks_split_all_slots_evenly(shards):
    total, at, all_counts = 50_000, 0, []
    for chunk in range(-(-shards // X.CHUNK_SHARDS)):
        first, counts = X.split(total, shards, chunk, (7, "s"))
        assert first == at
        at += counts.sum()
        all_counts += list(counts)
    assert at == total and len(all_counts) == shards
    mean = total / shards
    chi2 = sum((c - mean) ** 2 / mean for c in all_counts)
    assert shards == 1 or abs(chi2 - (shards - 1)) < 6 * (2 * shards) ** 0.5  # as multinomial counts scatter


def test_hard_rows_and_empty_table(spark):
    rows = [(i, "a" if (i or 0) % 2 else None, t) for i, t in hard_rows()]
    _, _, taken, _ = run(spark, rows)
    assert len(taken) == len(rows) and all(r.taken <= 2 * r.size for r in taken)
    _, mixed, taken, spans = run(spark, [])
    assert taken == [] and spans == [] and mixed.sources.count() == 0
    _, _, taken, spans = run(spark, [(1, "a", None), (2, None, "")])
    assert [r.taken for r in taken] == [0, 0] and spans == []


def test_sizes_are_words_between_blanks(spark):
    _, _, taken, _ = run(spark, [(1, "a", "ü x\t\v b\f\r\n c ☃.")])
    assert [r.size for r in taken] == [len([w for w in "ü x\t\v b\f\r\n c ☃.".replace(" ", "_").split()])]


def test_no_source_is_cut_to_one_task(spark):
    """A source's documents are laid out in ranges, and its slots drawn in chunks of shards."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.repeat(F.lit("w "), 100).alias("text"))
    mixed = X.mix(docs, block_words=4, shard_blocks=100)
    per = mixed.spans.select("shard", "place").distinct().groupBy("shard").count().collect()
    assert len(per) == 1500 and max(r["count"] for r in per) < 200
