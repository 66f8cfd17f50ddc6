import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import make, sentence, words

from lakestone.llm import neardup as N
from lakestone.llm.components import components


def bag(text):
    w = words(text)
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute_classes(rows, least=0.8):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = sum((bags[i] & bags[j]).values()), sum(bags[i].values()) + sum(bags[j].values())
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (both and both / (all_ - both) >= least):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        groups[root(i)].append(ident)
    return sorted(sorted(map(str, g)) for g in groups.values())


def got_classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.class_id if r.class_id is not None else f"none{r.node}"].append(str(r.doc_id))
    return sorted(sorted(g) for g in groups.values())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.integers(1, 20, 300)
    b = np.where(rng.random(300) < 0.4, rng.integers(1, 20, 300), a)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = N.signatures(np.repeat([0, 1], 300), np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, 8192)
    assert abs((s[0] == s[1]).mean() - exact) < 0.02
    alone = N.signatures(np.zeros(300, np.int64), shingle, a, 1, 8192)
    assert (alone[0] == s[0]).all()  # a signature doesn't depend on the texts beside it


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        w = sentence(rng, rng.randrange(8, 160), 2000).split()
        rows.append((10 * i, " ".join(w)))
        for k in range(rng.randrange(4)):
            for _ in range(rng.randrange(1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            rows.append((10 * i + k + 1, " ".join(w)))
    rng.shuffle(rows)
    got = N.classes(make(spark, rows)).collect()
    assert got_classes(got) == brute_classes(rows)
    assert all(r.class_id <= r.doc_id for r in got)


def test_large_group_of_near_copies(spark):
    """More members than one verification group holds, each a different text."""
    rng = random.Random(6)
    w = sentence(rng, 100, 3000).split()
    rows = []
    for i in range(700):
        v = list(w)
        v[i % 100] = f"own{i}"
        rows.append((i, " ".join(v)))
    got = N.classes(make(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {700}
    assert [r.doc_id for r in N.deduplicate(make(spark, rows)).collect()] == [0]


def test_hard_rows(spark, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = N.classes(hard).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {by_id[i].class_id for i in (1, 2, 3, 14)} == {1} and by_id[1].class_size == 5
    assert by_id[4].class_id == by_id[5].class_id == 4 and by_id[7].class_id == by_id[8].class_id == 7
    assert by_id[6].class_id == 6 and by_id[9].class_id == 9
    kept = N.deduplicate(hard).collect()
    assert Counter(r.doc_id for r in kept)[14] == 0 and Counter(r.doc_id for r in kept)[1] == 1
    assert len(kept) == len(got_classes(got)) and kept[0].asDict().keys() == hard.first().asDict().keys()
    assert N.classes(empty).count() == 0 and N.deduplicate(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500
    assert components(links.limit(0)).count() == 0


def test_no_link_between_classes_is_lost_in_a_crowded_band(spark):
    """Many texts share bands at similarities below 0.8; the close pairs among them must be found."""
    rng = random.Random(7)
    base = sentence(rng, 120, 3000).split()
    rows = []
    for i in range(150):
        a = list(base)
        for at in rng.sample(range(120), rng.choice((1, 3, 4, 5))):
            a[at] = f"p{rng.randrange(10**6)}"
        b = list(a)
        for at in rng.sample(range(120), 2):
            b[at] = f"q{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = N.classes(make(spark, rows)).collect()
    assert got_classes(got) == brute_classes(rows)


def test_left_over_pairs_are_compared(spark):
    """Texts that no leader joins: the links within the band are found in squares of cells."""
    rng = random.Random(13)
    texts = []
    for _ in range(30):
        w = sentence(rng, 100, 5000).split()
        texts += [" ".join(w), " ".join(w[:50] + ["edit"] + w[51:])]
    members = spark.createDataFrame([(1, n) for n in range(60)] + [(2, n) for n in range(60)], "key long, node long")
    none = spark.createDataFrame([], "a long, b long, similarity double")
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    size, N.GROUP = N.GROUP, 16
    try:
        found = {tuple(sorted((r.a, r.b))) for r in N._left_over(members, none, table, 5, 0.8).collect()}
    finally:
        N.GROUP = size
    assert found == {(2 * i, 2 * i + 1) for i in range(30)}


@pytest.mark.parametrize("limit", [7, 50, 1 << 16])
def test_forest_keeps_components_and_thins_links(spark, monkeypatch, limit):
    from lakestone.llm import components as C
    monkeypatch.setattr(C, "FOREST_LINKS", limit)
    rng = random.Random(limit)
    pairs = [(rng.randrange(c * 40, c * 40 + 40), rng.randrange(c * 40, c * 40 + 40)) for c in range(6) for _ in range(150)]
    pairs = [(a, b) for a, b in pairs if a != b] + [(999, 999)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.component for r in C.components(links).collect()} == {x: root(x) for x in list(parent)}
    tasks = -(-links.distinct().count() // limit)
    kept = links.distinct().repartition(tasks).mapInArrow(C._forest, "a long, b long").count()
    assert kept <= min(links.distinct().count(), tasks * len(parent))
