"""Quoted CSV in many tasks, against the reader that takes a file as one task."""

import os
import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lakestone.sources import quoted_csv as Q
from lakestone.sources.readers import read_csv_tokens

SCHEMA = StructType([StructField("id", LongType()), StructField("body", StringType()), StructField("note", StringType())])
TEXT = StructType([StructField(f.name, StringType()) for f in SCHEMA])


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def field(rng):
    alphabet = ["a", "b", " ", "\n", '"', ",", "é", "\\", "'"]
    text = "".join(rng.choices(alphabet, k=rng.randrange(0, 30)))
    return text if rng.random() < 0.7 else text + "\n" * rng.randrange(3) + "x" * rng.randrange(400)


def quoted(text, rng):
    if set(text) & set('\n",') or text.strip() != text or rng.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    return text


def write(folder, rng, n_files, n_rows, header="id,body,note", end="\n"):
    os.makedirs(folder)
    for k in range(n_files):
        rows = [f"{k * 1000 + i},{quoted(field(rng), rng)},{quoted(field(rng), rng)}" for i in range(n_rows)]
        with open(f"{folder}/part-{k}.csv", "w", newline="") as out:
            out.write(end.join([header, *rows]) + (end if rng.random() < 0.5 else ""))
    return str(folder)


def one_task(spark, path):
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
            .option("mode", "FAILFAST").schema(TEXT).csv(path))


def same(spark, path):
    got = Q.read_quoted_csv(spark, path, TEXT)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, one_task(spark, path).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_one_task_reader(small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    path = write(tmp_path / "in", rng, 2, rng.choice([1, 7, 40]), '"id","body","no\nte"' if seed % 2 else "id,body,note")
    same(small_blocks, path)


def test_one_file_is_many_tasks(small_blocks, tmp_path):
    path = write(tmp_path / "in", random.Random(1), 1, 100)
    assert Q.record_texts(small_blocks, path).rdd.getNumPartitions() > 20
    assert Q.record_texts(small_blocks, path).count() == 100


def test_a_record_over_many_blocks(small_blocks, tmp_path):
    (tmp_path / "in").mkdir()
    long = "line, with ""commas""\n" * 60
    (tmp_path / "in" / "a.csv").write_text(f'id,body,note\n1,"{long}",x\n2,"{long}","{long}"\n3,,\n')
    same(small_blocks, str(tmp_path / "in"))


def test_quotes_that_open_nothing(small_blocks, tmp_path):
    """A quote inside an unquoted field is a character: parity alone would read on to the next quote."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,body,note\n" + "".join(f'{i},five 5" disk,"a\nb"\n' for i in range(40)))
    same(small_blocks, str(tmp_path / "in"))


def test_carriage_returns_blank_lines_and_no_rows(small_blocks, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b'id,body,note\r\n1,"a\nb",x\r\n\r\n2,c,d\r\n')
    got = Q.read_quoted_csv(small_blocks, str(tmp_path / "in"), TEXT).collect()
    assert sorted(map(tuple, got)) == [("1", "a\nb", "x"), ("2", "c", "d")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("id,body,note\n")
    (tmp_path / "none" / "b.csv").write_text("")
    assert Q.read_quoted_csv(small_blocks, str(tmp_path / "none"), TEXT).collect() == []


def test_transition_of_a_line():
    cases = [("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('"a""', False, True), ('a"b', False, False),
             ('b",c', True, False), ('b"",c', True, True), ('b","c', True, True), ("", True, True), ("", False, False), ('"', True, False),
             ('""', False, False), ('"""', False, True), ('a,"b"c,"d', False, True)]
    for line, inside, want in cases:
        assert Q.ends_inside(line, inside) is want, (line, inside)


def test_null_tokens_and_types(small_blocks, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,body,note\n7,"a\nNULL",NA\n8,null,""\n')
    got = read_csv_tokens(small_blocks, str(tmp_path / "in"), SCHEMA, multi_line=True).collect()
    assert sorted(map(tuple, got)) == [(7, "a\nNULL", None), (8, None, None)]


def test_only_fragments_are_shuffled(spark, tmp_path):
    path = write(tmp_path / "in", random.Random(2), 1, 50)
    plan = Q.read_quoted_csv(spark, path, TEXT)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SinglePartition" not in plan
