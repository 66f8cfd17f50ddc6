"""Rows and helpers that the tests of the training-data operators share."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Columns whose names the operators use themselves.
EXTRA = "block string, score string, spans string, size int, node string, fingerprint string, bucket string, n_chars long"
SCHEMA = f"doc_id long, text string, lang string, {EXTRA}"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "b", "s", "p", 1, "n", "f", "k", len(t or "")) for i, t in rows], SCHEMA)


def hard_rows():
    """Nulls, empty and wordless texts, a very long one, copies, near copies, repeated rows, equal ids."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 70, 5000)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "!!! ..."), (7, "one two"), (8, "ONE, two"),
            (9, sentence(rng, 30_000, 100_000)), (10, "Ünïcode ŕows ára fine ☃ " + passage), (11, sentence(rng, 90) + " " + passage),
            (12, passage + " " + sentence(rng, 200)), (None, sentence(rng, 60)), (None, None), (13, sentence(rng, 4)),
            (14, base), (14, base), (15, "x" * 5000), (15, sentence(rng, 55)), (16, "the " * 300)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 200))) for i in range(60)]
    return rows
