"""Registered queries against their SQL, and their column contracts, on the smallest tables."""

import os

import duckdb
import pytest

from lakestone.llm.oracle import ORACLE
from lakestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

COLUMNS = {
    1: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    2: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    5: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    8: ["doc_id", "held_out", "score", "predicted"],
    10: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    11: ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    12: ["doc_id", "size", "source_size", "target", "taken"],
    13: ["doc_id", "n_features", "weight", "score", "rank"],
}


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_over_whole_tables(spark, name):
    df = QUERIES[name](spark, SF)
    n = int(name.split("_")[0][2:])
    table = "pages" if n == 7 else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count() * (2 if n == 7 else 1)
    assert set(COLUMNS.get(n, [])) <= set(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
    assert sorted(map(repr, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(repr, cur.fetchall()))
