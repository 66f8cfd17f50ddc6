import itertools
import random
import re
from collections import defaultdict

from llm_cases import make

from lakestone.llm import packing as P


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts, buckets = [rng.randrange(1, 9) for _ in lengths], rng.randrange(1, 6)

        def cost(tops):
            return sum(c * min(t for t in tops if t >= n) for n, c in zip(lengths, counts, strict=True))

        best = min(cost([*x, lengths[-1]]) for x in itertools.combinations(lengths[:-1], min(buckets, len(lengths)) - 1))
        got = P.boundaries(lengths, counts, buckets)
        assert cost(got) == best and len(got) <= buckets
    assert P.boundaries([], [], 4) == []


def test_every_row_has_one_place(spark, hard, empty):
    budget = 600
    got = P.pack(hard, buckets=5, token_budget=budget).collect()
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    want = sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (b, k), members in batches.items():
        size = max(1, budget // members[0].bucket_len)
        assert sorted(r.place for r in members) == list(range(len(members)))
        assert len(members) == size or (k == last[b] and len(members) < size)
    assert P.pack(empty).count() == 0


def test_repeated_rows_share_no_place(spark):
    got = P.pack(make(spark, [(1, "a b c")] * 500), token_budget=40).collect()
    assert len({(r.bucket, r.batch, r.place) for r in got}) == 500


def test_long_documents_are_padded_to_a_length_that_occurs(spark):
    sizes = [1001, 1001, 5001, 700, 21845, 21845, 21845]
    got = {r.doc_id: r for r in P.pack(make(spark, [(i, "x " * (n - 1)) for i, n in enumerate(sizes)]), buckets=4).collect()}
    assert all(got[i].n_tokens == got[i].bucket_len == n for i, n in enumerate(sizes))
    assert len({got[i].batch for i in (4, 5, 6)}) == 1  # three to the budget of 65,536
    tops = sorted(set(sizes))
    best = min(sum(min(t for t in (*cut, tops[-1]) if t >= n) for n in sizes) for cut in itertools.combinations(tops[:-1], 1))
    assert sum(r.bucket_len for r in P.pack(make(spark, [(i, "x " * (n - 1)) for i, n in enumerate(sizes)]), buckets=2).collect()) == best
