import hashlib
import random

import numpy as np
import pyarrow as pa
from llm_cases import hard_rows, make, sentence, words

from lakestone.llm import fingerprint as P


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_edited_texts_and_likeness(spark, hard, empty):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(1, 400))) for i in range(300) if i != 50] + [(999, None), (-5, "Ünï ☃" * 9)]
    got = {r.doc_id: r for r in P.compare_edited(make(spark, rows).repartition(7)).collect()}
    order = sorted(rows, reverse=True)
    errors = []
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        edited = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingle_set(t), shingle_set(edited)
        errors.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    assert len(P.compare_edited(hard).collect()) == len(hard_rows()) and P.compare_edited(empty).count() == 0
    by_text = {}
    for r in P.fingerprints(hard).collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    lone = P.compare_edited(make(spark, [(1, "abcd")])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1.0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000).astype(np.uint64) * 2, rng.integers(0, 2**63, 3000).astype(np.uint64) * 2
    b = np.concatenate([b, a[:2000]])
    whole, parts = P.sketch(a), [P.sketch(x) for x in np.array_split(a, 7)]
    merged = parts[0]
    for x in parts[1:]:
        merged = P.merge(merged, x)
    assert (merged == whole).all() and (P.decode(P.encode(whole)) == whole).all()
    k = 2048
    sa, sb = P.sketch(a, k), P.sketch(b, k)
    assert abs(P.resemblance(sa, sb, k) - 2000 / 8000) < 0.04
    assert abs(P.distinct(sa, k) / 5000 - 1) < 0.08 and abs(P.containment(sb, sa, k) - 0.4) < 0.06
    assert P.distinct(P.sketch(a[:50])) == 50 and P.resemblance(a[:0], a[:0]) == 1.0 and P.resemblance(whole, a[:0]) == 0.0


def test_equal_texts_have_equal_sketches_anywhere():
    texts = ["a b c d e f g", None, "", "x", "a b c d e f g", "A, b c d e f G!"]
    s = P.sketches(pa.array(texts))
    assert (s[0] == s[4]).all() and (s[0] == s[5]).all() and len(s[1]) == len(s[2]) == 0 and len(s[3]) == 1


def test_cuts_of_ids_beyond_doubles(spark):
    import numpy as np
    from llm_cases import make

    from lakestone.llm import fingerprint
    big = (1 << 60) + 1
    rows = make(spark, [(big + 2 * i * 1001, "a b c d e f") for i in range(400)])
    got = fingerprint._bounds(rows, 16, big + 2 * 399 * 1001)
    assert len(got) > 10 and {int(x) for x in got} <= {big + 2 * i * 1001 for i in range(400)}
    assert (np.diff(got) > 0).all()
    texts = [f"w{i} a b c d e f g {i}" for i in range(400)]
    small, large = (fingerprint.compare_edited(make(spark, [(f(i), t) for i, t in enumerate(texts)])).collect()
                    for f in (lambda i: i, lambda i: big + 2 * i * 1001))
    assert sorted(tuple(r)[1:] for r in small) == sorted(tuple(r)[1:] for r in large)
