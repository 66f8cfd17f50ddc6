import itertools
import random

import numpy as np
import pyarrow as pa
from llm_cases import make, sentence

from lakestone.llm import toxicity as T
from lakestone.llm.textops import Words, pieces


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 0, 6, 3]
    first = np.r_[0, np.cumsum(sizes)]
    odds, step = np.exp(rng.normal(size=first[-1])), np.exp(rng.normal(size=(2, 2)))
    p, expected = T.forward_backward(odds, first, step, pairs=True)
    pairs = np.zeros((2, 2))
    for a, z in zip(first[:-1], first[1:], strict=True):
        total, ones, own = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(z - a)):
            w = np.prod([odds[a + i] ** v for i, v in enumerate(y)]) * np.prod([step[u, v] for u, v in itertools.pairwise(y)])
            total += w
            ones += w * np.array(y)
            for u, v in itertools.pairwise(y):
                own[u, v] += w
        if z > a:
            assert np.allclose(p[a:z], ones / total)
            pairs += own / total
    assert np.allclose(expected, pairs)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    bad = ["idiot", "scumbag", "scumlike", "scumful", "wretch"]
    rows, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randrange(5, 90), 800).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs = make(spark, rows + [(None, None), (9000, ""), (9001, "!!!")])
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (5, labels[5][1])], "doc_id long, toxic int")
    model = T.train(docs, table)
    got = T.score(docs, model).collect()
    truth, text = dict(labels), dict(rows)
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    hits = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(hits) / len(hits) > 0.97
    spans = [text[r.doc_id][s.start:s.end] for r in got for s in r.spans]
    assert len(spans) > 200 and sum(any(x in s for x in ("idiot", "scum", "wretch")) for s in spans) / len(spans) > 0.9
    clean = {r.doc_id for r in got if r.predicted == 0}
    assert {r.doc_id for r in T.reject(docs, model).collect()} == clean and {None, 9000, 9001} <= clean


def test_labels_of_held_out_rows_change_nothing(spark):
    import zlib
    rows, labels = corpus(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    docs = make(spark, rows)
    a, b = (T.score(docs, T.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"))) for x in (labels, flipped))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_without_both_classes_the_prior_decides(spark, hard, empty):
    table = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (table, table.limit(0)):
        assert all(r.score < 0.01 and r.predicted == 0 for r in T.score(hard, T.train(hard, labels)).collect())
    assert T.score(empty, T.train(empty, table)).count() == 0


def test_scores_do_not_depend_on_neighbours():
    rows, labels = corpus(300, 2)
    texts = pa.array([t for _, t in rows])
    model = T.fit(texts, np.array([y == 1 for _, y in labels]), (1.0, 1.0))

    def scores(t, limit):
        out = []
        for _, _, data, offsets in pieces(t, limit):
            w = Words(data, offsets)
            out.append(model.scores(model.marginals(w), w.first))
        return np.concatenate(out)

    assert np.allclose(scores(texts, 1 << 20), scores(texts, 500), atol=1e-12)
