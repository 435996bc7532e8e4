"""The JSON array in parts: whole text, order, failed tasks, repeated writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lawmill.sources import json_array as J
from lawmill.sources import readers as R

KIND = "id long, text string, more array<struct<a:int,b:string>>"


def whole(folder):
    return "".join(open(f"{folder}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(folder)) if n.startswith("part-"))


def test_parts_are_one_array(spark, tmp_path):
    rows = [(i, f"Điều {i}\n\"x\"", [(i, None)]) if i % 5 else (i, None, []) for i in range(40)]
    R.write_json_array(spark.createDataFrame(rows, KIND).repartition(7), str(tmp_path / "a"), ["id"])
    want = [{"id": i, "text": t, "more": [{"a": a, "b": b} for a, b in m]} for i, t, m in rows]
    assert whole(tmp_path / "a") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    assert sorted((r["id"], r["text"]) for r in J.read(spark, str(tmp_path / "a"), KIND).collect()) == [(i, t) for i, t, _ in rows]
    assert os.listdir(tmp_path) == ["a"]


def test_empty_frames_and_writing_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", None)], KIND)
    R.write_json_array(rows, str(tmp_path / "a"), ["id"])
    R.write_json_array(rows.limit(0), str(tmp_path / "a"), ["id"])
    assert json.loads(whole(tmp_path / "a")) == [] and J.read(spark, str(tmp_path / "a"), KIND).count() == 0
    with pytest.raises(Exception, match="FileExistsError"):
        rows.write.format("json_array").mode("append").save(str(tmp_path / "a"))
    assert json.loads(whole(tmp_path / "a")) == [] and os.listdir(tmp_path) == ["a"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(J.JsonArray)
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("json_array").mode("overwrite").save(str(tmp_path / "a"))
    assert os.listdir(tmp_path) == []
