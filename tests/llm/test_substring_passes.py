import zlib

import numpy as np
import pytest
from llm_cases import make, sentence

from lakestone.llm import blocks
from lakestone.llm import substring as S


@pytest.mark.parametrize("width", [1, 2, 3])
def test_rows_of_numbers_come_back_from_planes(width):
    a = np.arange(60, dtype=np.int64).reshape(-1, width) * 7919 - 100
    a = a[:, 0] if width == 1 else a
    assert (blocks.from_planes(blocks.planes(a), np.int64, width) == a).all()


def test_a_constant_column_costs_next_to_nothing():
    rng = np.random.default_rng(5)
    owner = rng.integers(0, 1 << 16, 20000)
    alone = len(zlib.compress(blocks.planes(owner)))
    both = len(zlib.compress(blocks.planes(np.stack([owner, np.full(len(owner), S._NONE)], 1))))
    assert both < 1.1 * alone


def test_two_owners_say_whether_a_key_is_shared():
    """Windows and long runs: two different numbers where two documents have the key, negative ids and 0 among them."""
    where = [np.array([0, 1, 2]), np.array([1, 2, 3])]
    values = [np.array([[5, S._NONE], [0, S._NONE], [-1, 3]]), np.array([[7, S._NONE], [-1, S._NONE], [0, S._NONE]])]
    for level in (0, S._RUNS):
        found = S._two_owners(level, np.arange(4, dtype=np.uint64), where, values)
        shared = [(x[:, 0] != x[:, 1]).tolist() for x in found]
        assert shared == [[False, True, True], [True, True, False]]
    assert found[0][1:, 0].tolist() == [0, -1] and found[1][:2, 0].tolist() == [0, -1]


def test_lookups_are_not_run_again_for_the_result(spark):
    import random
    rng = random.Random(3)
    part = sentence(rng, 80, 3000)
    found = S.repeated(make(spark, [(i, sentence(rng, 20, 3000) + " " + part) for i in range(4)]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert [len(r._passages) for r in found.orderBy("doc_id").collect()] == [1] * 4


def test_windows_of_one_text_and_min_hash_move_their_words_once():
    """Overlapping windows are one span, equal words have one mark, and other words another."""
    import pyarrow as pa
    text = " ".join(f"w{i}" for i in range(300))
    table = pa.table({"_block": [0, 0], "_owner": [1, 2], "_mark": [5, 5], "text": [text, text]})
    b = S._Block(table, "text", 1)
    value, wanting = np.array([7, 7, 9, 7, 7], np.uint64), np.array([False, True, False, False, False])
    found = S._merged(b, 0, (value, np.array([0, 60, 0, 300, 360]), np.array([100, 160, 90, 400, 460]), wanting))
    assert [(v, t, spans) for v, _, t, spans in found] == [
        (7, 0, [(0, 160, True)]), (9, 0, [(0, 90, False)]), (7, 1, [(300, 460, False)])]
    assert found[0][1] == found[2][1] != found[1][1]


def test_stretches_that_overlap_are_all_found():
    """An edit every 31 words: any two runs match well enough, three do not."""
    at = np.concatenate([np.arange(25) + 31 * i for i in range(9)])
    found = S._near(at, np.zeros(len(at), np.int64), S.SHINGLE, S._need(0.8), S.PASSAGE)
    assert set(range(at[-1] + S.SHINGLE)) == {w for a, z, _ in found for w in range(a, z)}


def test_lookups_move_texts_once(spark):
    """All passes read one exchange of the texts and one of each lookup's answers."""
    rows = [(i, f"text {i}") for i in range(4)]
    docs = make(spark, rows).selectExpr("doc_id", "text", "doc_id _owner", "xxhash64(text) _mark")
    dealt, ranges = blocks.dealt(docs)
    found = S._found(dealt, ranges, "text", 50, 0.8, 3)
    assert len(found.collect()) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]  # the one that ran
    assert plan.count("Scan ") == 1 and "ReusedExchange" in plan


def test_a_result_without_texts_moves_none(spark):
    part = " ".join(f"w{i}" for i in range(60))
    found = S.repeated(make(spark, [(1, part), (2, part + " end")]), columns=["doc_id"])
    assert found.columns == ["doc_id", "_owner", "_n_words", "_passages"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("text#" in line for line in plan.splitlines() if "Exchange" in line or "FlatMapCoGroups" in line)
    assert [(r.doc_id, len(r._passages)) for r in found.orderBy("doc_id").collect()] == [(1, 1), (2, 1)]


def test_places_in_a_block_do_not_depend_on_the_order_of_its_rows():
    """Passes hand places on, and a shuffle gives a block's rows in another order each time."""
    import random

    import pyarrow as pa
    rng = random.Random(5)
    texts = [sentence(rng, 90, 3000) for _ in range(5)]
    table = pa.table({"_block": [0] * 6, "_owner": [4, 1, 3, 1, 2, 1], "_mark": [9, 8, 7, 6, 5, 8], "text": [*texts, texts[1]]})
    sent = S._windows_sent("text", 1, 50, 3)(table)
    told = [(0, 0, k, blocks.planes(np.tile(np.array([[1, 2]]), (len(blocks.unpack_keys(x)), 1))))
            for k, x in zip(sent["level"].to_pylist(), sent["keys"].to_pylist(), strict=True)]
    answers = pa.table([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), blocks.ANSWER_ARROW, strict=True)], schema=blocks.ANSWER_ARROW)
    run = S._runs_sent("text", 1, 50, 3)
    first = run(table, answers)
    assert first.num_rows == 4 and all(run(table.take(order), answers) == first for order in ([5, 4, 3, 2, 1, 0], [2, 0, 5, 3, 1, 4]))
