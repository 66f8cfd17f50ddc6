import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from llm_cases import hard_rows, make, sentence, words
from pyspark.sql import functions as F

from lakestone.llm import importance as I


def grams(text, most):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most, buckets, percent, least):
    hist = [Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, most))
            for texts in ([t for _, t in docs], target)]
    s_all, t_all = (sum(x.values()) for x in hist)
    gain = [math.floor(1000 * math.log((hist[1][b] + 1) * (s_all + buckets) / ((hist[0][b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    rows = []
    for i, t in docs:
        f = grams(t, most)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([len(words(t)), (i, len(f), weight, score)])
    able = sorted((r for n, r in rows if n >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    want = percent * len(able) // 100
    out = [(*r, k + 1 if k < want else None) for k, r in enumerate(able)] + [(*r, None) for n, r in rows if n < least]
    return sorted(out, key=repr)


def run(spark, docs, target, **how):
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, buckets int")
    got = I.resample(make(spark, docs), goal, **how).collect()
    return sorted((tuple(r) for r in got), key=repr)


TARGET = ["w1 w2 w3 w4 " * 30, None, "", "Other, WORDS: here; w1", sentence(random.Random(1), 300, 40)]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10000, 10, 20), (2, 500, 35, 3), (3, 10000, 100, 0), (1, 7, 0, 20)])
def test_equals_brute_force_on_hard_rows(spark, most, buckets, percent, least):
    rows = hard_rows()
    got = run(spark, rows, TARGET, most=most, buckets=buckets, percent=percent, least_words=least)
    assert got == brute(rows, TARGET, most, buckets, percent, least)


def test_ties_go_to_smaller_ids_and_copies_side_by_side(spark):
    rows = [(i % 50, "same words " * 15) for i in range(500)]
    assert run(spark, rows, TARGET) == brute(rows, TARGET, 1, 10000, 10, 20)


def test_empty_tables(spark, empty):
    goal = spark.createDataFrame([], "text string")
    assert I.resample(empty, goal).collect() == []
    rows = hard_rows()
    assert run(spark, rows, []) == brute(rows, [], 1, 10000, 10, 20)


def test_spans_are_the_runs_of_words():
    text = "  Ünï, a--b\x00c Ωx 12_3 ☃ " * 3
    for most in (1, 2, 4):
        n, found = I.spans(text, most)
        assert n == len(words(text)) and Counter(found) == Counter(g.encode() for g in grams(text, most))
    assert I.spans("", 2) == (0, []) and I.spans("?!", 2) == (0, [])


def test_draw_prefers_the_target(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60, 40) if i % 10 == 0 else "z" + sentence(rng, 60).replace("w", "z")) for i in range(2000)]
    goal = [sentence(rng, 500, 40) for _ in range(5)]
    drawn = [r for r in run(spark, rows, goal) if r[4] is not None]
    assert len(drawn) == 200 and sum(r[0] % 10 == 0 for r in drawn) > 150


def test_whole_long_text_counts(spark):
    text = sentence(random.Random(2), 200_000, 50_000)
    got = run(spark, [(1, text)], TARGET, percent=100)
    assert got == brute([(1, text)], TARGET, 1, 10000, 100, 20) and got[0][1] == 200_000


def test_extra_columns_do_not_matter(spark):
    rows = hard_rows()
    docs = make(spark, rows)
    named = docs.withColumn("weight", F.lit("w")).withColumn("rank", F.lit("r")).withColumn("n_words", F.lit("n")).withColumn("_key", F.lit(1))
    goal = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert sorted(map(repr, I.resample(named, goal).collect())) == sorted(map(repr, I.resample(docs, goal).collect()))
