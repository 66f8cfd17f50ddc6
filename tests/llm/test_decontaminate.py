import random
import time

import pytest
from llm_cases import sentence, words

from lakestone.llm import decontaminate as D


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for ident, item in items:
        iw = words(item)
        if not iw:
            continue
        m = min(window, len(iw))
        grams = {tuple(iw[j:j + m]) for j in range(len(iw) - m + 1)}
        at = [p for p in range(len(w) - m + 1) if tuple(w[p:p + m]) in grams]
        if at:
            found.add(str(ident))
            hit.update(q for p in at for q in range(p, p + m))
    return sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randrange(12, 60), 300)) for i in range(25)]
    items += [(40, "alpha beta"), (41, "Solo"), (42, ""), (43, None), (44, items[0][1]), (45, "x " * 30)]
    rows = []
    for i in range(80):
        w = sentence(rng, rng.randrange(0, 150), 300).split()
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items[:25])[1])
            a = rng.randrange(len(part))
            w[len(w) // 2:len(w) // 2] = part[a:a + rng.randrange(5, 30)]
        rows.append((i, " ".join(w)))
    rows += [(90, "ALPHA,  beta and solo"), (91, None), (92, ""), (93, "x " * 500), (93, "x " * 500), (None, items[3][1])]
    return rows, items


def test_hits_equal_brute_force(spark, case):
    rows, items = case
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, words string")
    got = D.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "words"}
    want = sorted((str(i), *map(str, brute(t, items))) for i, t in rows)
    assert sorted((str(r.doc_id), str(list(r._hit)), str(list(r._items))) for r in got) == want


def test_no_python_in_the_plan(spark, case):
    rows, items = case
    df = D.hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_clean_documents_stay(spark, hard, empty):
    bench = spark.createDataFrame([(1, "nothing of this kind stands in any of the documents here at all")], "item_id long, text string")
    assert sorted(map(repr, D.decontaminate(hard, bench).collect())) == sorted(map(repr, hard.collect()))
    assert D.decontaminate(empty, bench).count() == 0
    assert D.decontaminate(hard, bench.limit(0)).count() == hard.count()


def test_repeated_words_cost_a_row_a_position(spark):
    """A long text of one word against an item of the same word: no words in seeds, no pair of positions."""
    docs = spark.createDataFrame([(1, "x " * 40_000), (2, "x y " * 20_000), (3, "x " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 1000), (2, "x y " * 500)], "item_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: (len(r._hit), list(r._items)) for r in D.hits(docs, items).collect()}
    assert got == {1: (40_000, ["1"]), 2: (40_000, ["2"]), 3: (0, [])}
    assert time.monotonic() - start < 60  # a few seconds alone


def test_columns_may_have_any_name_but_the_three_it_adds(spark, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["_k1", "_k2", "_seeds", "_body", "_row", "_near", "__slot", "__mask", "pos", "hash"]
    docs = spark.createDataFrame([(i, t, *range(10)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, D.decontaminate(plain, bench).collect()))
    assert D.hits(docs, bench).count() == len(rows)
    clash = plain.withColumnRenamed("doc_id", "_hit")
    assert D.decontaminate(clash, bench).columns == ["_hit", "text"]
    with pytest.raises(ValueError, match="_hit"):
        D.hits(clash, bench)


def test_only_hit_texts_are_shuffled_at_any_size(spark, case):
    """Joins with texts are sort-merge joins behind a filter, whatever the broadcast threshold says."""
    rows, items = case
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = []
    for limit in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        plans.append(D.hits(docs, bench)._jdf.queryExecution().executedPlan().toString())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [p.count("SortMergeJoin") for p in plans] == [1, 1]
