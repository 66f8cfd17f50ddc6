import numpy as np
import pytest
from llm_cases import make

from lakestone.llm import tokencount as T
from lakestone.session import local_path, scratch_path


def write(spark, name, arrays, kind):
    import os
    folder = local_path(scratch_path(spark, name))
    folder = "/" + folder.lstrip("/")
    os.makedirs(folder)
    paths = []
    for k, a in enumerate(arrays):
        paths.append(f"{folder}/{k}.bin")
        np.asarray(a, kind).tofile(paths[-1])
    return paths


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_counts_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    # Runs of ordinary ids, some longer than many blocks; the last document of one file is open; one file is empty.
    arrays = [np.concatenate([np.r_[rng.integers(1, 9, rng.integers(0, 40)), 0] for _ in range(30)]),
              np.r_[np.ones(300), 0, 0, 5, 5], np.zeros(0), np.zeros(7)]
    paths = write(spark, "flat", arrays, "<u2")
    got = T.count_tokens(spark.createDataFrame([(p,) for p in paths], "path string"), 0, 2, block).collect()
    for path, a in zip(paths, arrays, strict=True):
        ends = [i for i, x in enumerate(a) if x == 0] + ([len(a)] if len(a) and a[-1] != 0 else [])
        want = [(k, s, e - s) for k, (s, e) in enumerate(zip([0, *[x + 1 for x in ends]], ends, strict=False))]
        assert sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.path == path) == want


def test_wide_ids_and_broken_files(spark):
    paths = write(spark, "wide", [[70000, 1, 50256, 50256]], "<u4")
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [(r.ordinal, r.n_tokens) for r in T.count_tokens(frame, 50256, 4).orderBy("ordinal").collect()] == [(0, 2), (1, 0)]
    with open(paths[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="whole number"):
        T.count_tokens(frame, 50256, 4).collect()


def test_documents_round_trip(spark, hard, empty):
    encode = T.bpe_encoder()()
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = T.document_counts(hard, block=512).collect()
    want = sorted((str(i), len(encode([t or ""])[0])) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert T.document_counts(empty).count() == 0
    assert T.document_counts(make(spark, [(1, None)])).first().n_tokens == 0
