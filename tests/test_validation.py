import json

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import bookkeeping, validation
from cinderloom.sources import datasets


def test_datasets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "x", "label": 1}\n')
    (tmp_path / "b.json").write_text('{"text": "y", "label": 0, "extra": 2}\n')
    rows = datasets.load(spark, {"train": str(tmp_path / "a.json"), "test": str(tmp_path / "b.json")})
    assert {(r.split, r.label) for r in rows.collect()} == {("train", 1), ("test", 0)} and datasets.num_labels(rows) == 2
    with pytest.raises(ValueError):
        datasets.load_options({"revision": "a"}, "b")
    paths = spark.createDataFrame([("/r/dataset_cycle_2/p",), ("/r/dataset_cycle_10/p",), ("/r/x",)], "path string")
    assert tuple(datasets.latest_snapshots(paths).first()) == ("/r", "/r/dataset_cycle_10", 10)
    named = spark.createDataFrame([(0, 1, "one"), (1, 1, "uno"), (2, 0, "zero")], "i int, label int, label_text string")
    assert {tuple(r) for r in datasets.label_names(named, "label", "i").collect()} == {(1, "one"), (0, "zero")}
    assert [r.label_text for r in datasets.decoded(named.select("label"), "label", ["no", "yes"]).collect()] == ["yes", "yes", "no"]
    plans = spark.createDataFrame([('[{"control_name": "c"}, {"x": "y"}]',), ("{}",), (None,)], "doc string")
    assert sorted(str(r.error) for r in datasets.plan_rows(plans).collect())[0] == "None"


def test_validation(spark):
    rows = spark.createDataFrame([("Yes.", "yes", 5, 5, 9), ("maybe", "no", 1, 1, 2)], "r string, g string, i int, o int, t int")
    assert validation.valid_labels(rows, "r", ["yes", "no"], "g").count() == 1
    assert validation.bad_usage(rows, "i", "o", "t").count() == 1
    assert validation.evaluation_split(["train", "test"]) == "test" and validation.heldout_split(["train", "validation", "test"]) == "test" and validation.heldout_split(["train", "test"]) is None
    with pytest.raises(ValueError):
        validation.require_splits(rows.withColumn("split", F.lit("train")))
    new = spark.createDataFrame([("p", "r", None), (" ", "r", None)], "student_prompt string, teacher_response string, gold_answer string")
    assert [r.gold_answer for r in validation.augmented_rows(new, 1, "t", "coverage").collect()] == ["r"]
    names = F.lit("same_count")
    assert spark.range(1).select(validation.is_fixed(F.lit("fixed_a"), names, ["same_count"]).alias("x")).first().x is False


def test_bookkeeping(spark, tmp_path):
    usage = spark.createDataFrame([(0, "a", 1, 2, 3), (1, "a", 1, 1, 2)], "cycle int, operation string, input_tokens long, output_tokens long, total_tokens long")
    doc = json.loads(bookkeeping.usage_document(usage, "e").first().value)
    assert doc["grand_total"]["total_tokens"] == 5 and doc["totals"]["a"]["output_tokens"] == 3 and [c["cycle"] for c in doc["per_cycle"]] == [0, 1]
    rows = bookkeeping.sweep_summary([{"name": "a", "metrics": {0: {"loss": 3.0}, 1: {"loss": 1.0}}}, {"name": "b", "error": "x"}], "loss", "min")
    assert rows[0]["best"] and rows[0]["best_cycle"] == 1 and rows[1]["loss"] is None
    bookkeeping.write_document(str(tmp_path / "m.json"), bookkeeping.run_manifest({"a": 1}, "completed", artifact_dir=str(tmp_path)))
    assert json.loads((tmp_path / "m.json").read_text())["status"] == "completed"
    assert bookkeeping.canonical_labels_document([" a", "a", "", "b"], "label")["labels"] == ["a", "b"]
