import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import re
from llm_cases import LOWER, make, sentence

from lakestone.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</s>"]


def held(ident):
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % 7 == 2


def brute(rows, order, weight=0.5):
    counts = [Counter() for _ in range(order)]
    texts = 0
    for i, t in rows:
        if not held(i):
            texts += 1
            w = tokens(t)
            for n in range(order):
                s = ["<s>"] * n + w
                counts[n].update(tuple(s[k:k + n + 1]) for k in range(len(w)))
    total, vocabulary = sum(counts[0].values()), len(counts[0])

    def p(history, word):
        out = (counts[0][word,] + 1) / (total + vocabulary + 1)
        for n in range(1, order):
            context = tuple(history[len(history) - n:])
            seen = texts if set(context) == {"<s>"} else counts[n - 1][context]
            if seen:
                out = weight * counts[n][context + (word,)] / seen + (1 - weight) * out
        return out

    result = []
    for i, t in rows:
        w = tokens(t)
        s = ["<s>"] * (order - 1) + w
        base = sum(math.log10((counts[0][x,] + 1) / (total + vocabulary + 1)) for x in w)
        full = sum(math.log10(p(s[:k + order - 1], x)) for k, x in enumerate(w))
        result.append((str(i), held(i), len(w), sum(counts[0][x,] > 0 for x in w), total, round(base, 6), round(full, 6)))
    return sorted(result), p, list(counts[0])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, sentence(rng, rng.randrange(0, 60), 30).title()) for i in range(80)] + [(80, None), (81, ""), (None, "a b c\td"), (80, "w1 w2")]
    got = lm.score(make(spark, rows), order=order, block_chars=900).collect()
    want, _, _ = brute(rows, order)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_model_is_a_distribution():
    rng = random.Random(3)
    rows = [(i, sentence(rng, 20, 12)) for i in range(30)]
    _, p, vocabulary = brute(rows, 3)
    for history in (["<s>", "<s>"], ["w1", "w2"], ["never", "w3"], ["never", "seen"]):
        assert abs(sum(p(history, w) for (w,) in vocabulary) + p(history, "unknown") - 1) < 1e-9


def test_hard_rows_and_empty_table(spark, hard, empty):
    got = lm.score(hard).collect()
    assert len(got) == hard.count() and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {1}
    assert lm.score(empty).count() == 0
    one = make(hard.sparkSession, [(next(i for i in range(99) if held(i)), "only held out")])
    assert [(r.n_known, r.train_tokens, r.score) for r in lm.score(one).collect()] == [(0, 0, 0.0)]


def test_counts_beyond_four_bytes():
    import numpy as np

    from lakestone.llm import lm
    kind = np.dtype(lm._KINDS)
    at = np.zeros(1, np.int64)
    got = lm._total(1, np.zeros(1, np.uint64), [at, at], [np.array([2**32 - 1], kind), np.array([5], kind)])
    assert [int(x[0]) for x in got] == [2**32 + 4] * 2


def _machine(rows, order, weight=0.5):
    """The automaton of all rows as one block, its tokens and the first token of each text."""
    import pyarrow as pa
    tokens_, first = lm._tokens(pa.array([t for _, t in rows]))
    train = np.repeat([not held(i) for i, _ in rows], np.diff(first))
    counts = []
    for g in lm._ngrams(tokens_, first, order):
        known, at = np.unique(g, return_inverse=True)
        counts.append(np.bincount(at, weights=train, minlength=len(known)).astype(np.uint64))
    n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
    return lm.Automaton(tokens_, first, counts, n + v + 1, sum(not held(i) for i, _ in rows), weight), tokens_, first


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_arc_by_arc_walk_equals_the_direct_formula(order):
    """One text at a time, one arc at a time, from dictionaries: arcs met, failure arcs followed, states carried."""
    rng = random.Random(order)
    rows = [(i, sentence(rng, rng.randrange(0, 40), 25)) for i in range(60)] + [(60, ""), (61, "unknown never"), (62, "w1 w2 w3 w1 w2 w3")]
    machine, tokens_, first = _machine(rows, order)
    arcs = {(int(c) // len(machine.words), int(c) % len(machine.words)): (w, int(t))
            for c, w, t in zip(machine.arcs, machine.weights, machine.targets)}
    assert len(arcs) == len(machine.arcs)
    failures, scores, per_token = 0, [], machine.run(first)
    for a, b in zip(first[:-1], first[1:]):
        state, total = machine.start, 0.0
        for word in machine.word[a:b]:
            while (state, int(word)) not in arcs:
                assert state != 0
                total, state, failures = total + machine.down, int(machine.fail[state]), failures + 1
            weight, state = arcs[state, int(word)]
            total += weight
        scores.append(total)
        assert abs(total - per_token[a:b].sum()) < 1e-9
    want = {x[0]: x[-1] for x in brute(rows, order)[0]}
    assert {str(i): round(x, 6) for (i, _), x in zip(rows, scores)} == want
    assert (failures > 0) == (order > 1)


def test_long_texts_are_walked_in_several_places(monkeypatch):
    rng = random.Random(8)
    rows = [(i, sentence(rng, n, 40)) for i, n in enumerate([500, 0, 3, 77, 200])]
    for order in (1, 2, 3, 4):
        whole = None
        for stride in (10_000, 64, 5, 1):
            monkeypatch.setattr(lm, "STRIDE", stride)
            machine, _, first = _machine(rows, order)
            got = machine.run(first)
            whole = got if whole is None else whole
            assert np.allclose(got, whole, atol=1e-12)
