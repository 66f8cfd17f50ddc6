import hashlib
import random

import pytest
from llm_cases import hard_rows, sentence
from pyspark.sql import functions as F

from lakestone.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, block string, `at` int, _leaf int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels of one tree, by the definition: runs of three become their digest while several nodes remain."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows, shown):
    """Sorted (id, leaf, subroot, root, proof, folded) of (id, source, lang, n_chars, text) rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = climb([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            proof, acc = [], h("".join(map(field, shown(r))))
            for tree, at in ((levels[s], i), (top, k)):
                for row in tree[:-1]:
                    low = at // 3 * 3
                    left, right = row[low:at], row[at + 1:low + 3]
                    proof += left + right
                    acc, at = h("".join(left) + acc + "".join(right)), at // 3
            out.append((r[0], leaf, levels[s][-1][0], top[-1][0], h("".join(proof)), acc))
    return sorted(out, key=repr)


def bare(r):
    return (*r[:4], r[4] and r[4].replace("\n", "")) if (r[0] or 1) % 2 == 0 else r


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "t", "b", 1, 2) for r in rows], SCHEMA)
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    shown = F.when(F.col("doc_id") % 2 == 0, M.leaf(*cols, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    made = M.manifest(docs, M.leaf(*cols, F.col("text")), shown)
    got = made.select("doc_id", "leaf", "subroot", "root", M.proof_digest(), "folded_root").collect()
    return sorted((tuple(x) for x in got), key=repr)


def corpus():
    rng = random.Random(3)
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "en", None if i % 7 == 0 else i, sentence(rng, 9) + ("\n" + sentence(rng, 3)) * (i % 4))
            for i in range(130)]
    rows += [(i, None, None, None, None) for i in range(1000, 1004)] + [(2005, "lone", "a", 1, "ü\n\n"), (2006, "-", "", 0, "")]
    rows += [(None, "s1", "x", 1, None), (None, "s1", "x", 1, "\n")] + [(77, "s2", "en", 5, "copy\n")] * 40
    return rows


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_the_definition_for_superblocks_of_any_size(spark, monkeypatch, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "SIZE", 3 ** height)
    assert run(spark, corpus()) == brute(corpus(), bare)


def test_repeated_rows_fill_several_superblocks(spark, monkeypatch):
    monkeypatch.setattr(M, "HEIGHT", 2)
    monkeypatch.setattr(M, "SIZE", 9)
    rows = [(8, "hot", "en", 1, "same\n")] * 100 + [(i, "hot", "en", 1, "x") for i in range(20)]
    assert run(spark, rows) == brute(rows, bare)


def test_one_source_one_row_and_none(spark):
    assert run(spark, [(2, None, None, None, "a\nb")]) == brute([(2, None, None, None, "a\nb")], bare)
    assert run(spark, []) == []


def test_only_changed_rows_fold_to_another_root(spark):
    rows = corpus()
    for r in run(spark, rows):
        changed = r[0] is not None and r[0] % 2 == 0 and any(x[0] == r[0] and "\n" in (x[4] or "") for x in rows)
        assert (r[5] != r[3]) == changed


def test_hard_texts(spark):
    rows = [(i, "s", "en", None, t) for i, t in hard_rows()]
    assert run(spark, rows) == brute(rows, bare)
