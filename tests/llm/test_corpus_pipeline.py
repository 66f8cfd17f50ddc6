import random
from collections import Counter

import pytest
from llm_cases import make, sentence, words
from test_neardup import got_classes
from test_substring import repeated_words

import corpus_pipeline as C
from lakestone.llm import neardup, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    item = sentence(rng, 30, 4000)
    for i in range(240):
        w = sentence(rng, rng.randrange(60, 160), 4000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    passage = sentence(rng, 65, 4000)
    rows += [(300, rows[1][1]), (301, rows[2][1] + " more"), (302, rows[3][1] + " " + passage),
             (303, sentence(rng, 90, 4000) + " " + passage), (304, sentence(rng, 50, 4000) + " " + item + " end"), (305, None), (306, "")]
    folder = str(tmp_path_factory.mktemp("tables"))
    make(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_on_its_own_input(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, tables)
        rows = out.collect()
        seen[name] = (before, {r.doc_id: (r.text if "text" in out.columns else None) for r in rows})
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    before, after = seen["toxicity"]
    toxic = {i for i, t in before.items() if t and ("idiot" in t or "moron" in t)}
    assert set(before) - set(after) == toxic
    before, after = seen["near_duplicates"]
    assert {300, 301, 306} == set(before) - set(after)  # 302 shares less than 0.8 with 3
    before, after = seen["repeated_passages"]
    assert set(before) == set(after)
    old = list(before.items())
    for (i, t), hit in zip(old, repeated_words(old), strict=True):
        if not hit:
            assert after[i] == t
    assert not any(repeated_words(list(after.items())))
    before, after = seen["decontamination"]
    assert set(before) - set(after) == {304}
    assert set(seen["packing"][1]) == set(seen["packing"][0])


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert C.run(spark, tables).count() > 150
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
