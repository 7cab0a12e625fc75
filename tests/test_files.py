"""File sources: bank order, strictness, text blocks and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from lumenbank.sources import files


def write(path, name, rows):
    (path / name).write_text(json.dumps(rows))


def test_bank_order_and_tiers(spark, tmp_path):
    q = {"id": "q1", "cluster": "c", "options": {"A": "a", "B": "b"}, "answer": "A", "difficulty": "HARD"}
    write(tmp_path, "b.json", [q, {**q, "id": "q2", "difficulty": None}])
    write(tmp_path, "a.json", [{**q, "id": "q3", "difficulty": "odd"}])
    rows = files.scan_bank(spark, f"{tmp_path}/*.json").orderBy("file", "pos").collect()
    assert [(r.id, r.pos, r.difficulty) for r in rows] == [("q3", 0, "medium"), ("q1", 0, "hard"), ("q2", 1, "medium")]
    assert rows[0].options == {"A": "a", "B": "b"}
    (tmp_path / "bad.json").write_text("{oops")
    assert files.scan_bank(spark, f"{tmp_path}/*.json").filter("id IS NOT NULL").count() == 3
    with pytest.raises(Exception):
        files.scan_bank(spark, f"{tmp_path}/*.json", strict=True).collect()


def test_lines_and_blocks(spark, tmp_path):
    (tmp_path / "pis.txt").write_text("# head\n- One thing # note\n\n• Two\nthree\n")
    assert sorted(r.line for r in files.scan_lines(spark, str(tmp_path / "pis.txt")).collect()) == ["One thing", "Two", "three"]
    block = "Question: What?\nA. one\nB. two\nC. three\nD. four\nAnswer: b\nExplanation: since\n"
    (tmp_path / "exam.txt").write_text(block + block.replace("D. four\n", ""))
    rows = files.read_blocks(files.scan_blocks(spark, str(tmp_path / "exam.txt"))).orderBy("pos").collect()
    assert [r.valid for r in rows] == [True, False]
    assert rows[0].answer == "B" and rows[0].options["C"] == "three"


def test_bank_and_snapshots_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("1", "c", "ICDC", "sets", "q")], "id string, cluster string, level string, section string, question string")
    files.write_bank(rows, f"{tmp_path}/bank")
    back = spark.read.parquet(f"{tmp_path}/bank").filter(F.col("level") == "ICDC")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(level" in back._jdf.queryExecution().toString()
    files.write_snapshot(rows, f"{tmp_path}/snap", "v1")
    assert files.read_snapshot(spark, f"{tmp_path}/snap", "v1").count() == 1
    with pytest.raises(Exception):
        files.write_snapshot(rows, f"{tmp_path}/snap", "v1")
