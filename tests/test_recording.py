"""Runs that audit clean, and the seed-record sink: commit, abort, refusal, retries, labels."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import config, loop, provenance, recording
from cinderloom.operators.students import HashedLogistic
from cinderloom.sources import artifacts, record_sink


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A clean source tree with lock files."""
    root = tmp_path_factory.mktemp("tree")
    for name in recording.LOCKFILES:
        (root / name).write_text(name)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    return root


def records(spark, n=50, parts=4):
    return spark.range(0, n, 1, parts).select(
        F.concat(F.lit("q"), "id").alias("student_prompt"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("ä\n"), "id")).alias("note"), F.lit(3).alias("teacher_input_tokens"), (F.col("id") % 5).alias("teacher_output_tokens"),
        (3 + F.col("id") % 5).alias("teacher_total_tokens"), (F.col("id") % 4 > 0).alias("teacher_gold_agreement"), (F.col("id") == 7).alias("usage_estimated"),
    )


def test_a_run_of_the_loop_with_seed_records_audits_clean(spark, tree, tmp_path):
    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} text {i % 7}", i % 2) for i in range(40)], "id long, text string, class_id int")
    teacher = lambda wrong, n: (spark.createDataFrame([(1000 + i, "good fine words", 1) for i in range(n)], "id long, text string, class_id int"), 13)
    seed = tmp_path / "seed"
    bare = config.from_dict({"name": "run", "cycles": 2, "token_budget": 100_000, "policy_name": "fixed_repair"})
    text = recording.config_text(bare)
    record_sink.write_records(records(spark), str(seed), rejected=2, manifest={"reproducibility": recording.reproducibility(bare, text, tree)})
    parts = sorted(str(p) for p in seed.glob("part-*.jsonl"))
    assert len(parts) == 4
    c = config.from_dict({"name": "run", "cycles": 2, "token_budget": 100_000, "policy_name": "fixed_repair", "dataset_kwargs": {"data_files": {"train": parts}}})
    out = loop.run(c, rows, rows, HashedLogistic(64, 5), teacher, str(tmp_path / "work"))
    whole = json.loads((seed / "manifest.json").read_text())
    recording.record(out, c, tmp_path / "runs" / "one", tree, seed_tokens={k.removeprefix("teacher_"): whole[k] for k in record_sink.TOKENS})
    every = artifacts.files(spark, str(tmp_path / "runs"))
    found = every.join(artifacts.run_dirs(every), "dir")
    seeds = provenance.seed_files(found, provenance.materialized(spark, str(seed)))
    told = provenance.audit(found, seeds).collect()
    assert [(r["passed"], r["failure_reasons"], r["data_files"], r["integrity_ok_files"], r["tokens_ok_files"]) for r in told] == [(True, "", 4, 4, 4)]
    tokens = provenance.seed_tokens(found, seeds).first()
    assert (tokens["seed_total_tokens"], tokens["online_total_tokens"], tokens["estimated_records"]) == (250, 13, 1)
    assert artifacts.attempts(found).count() == 1 and artifacts.contexts(found).first()["status"] == "completed"
    with pytest.raises(FileExistsError):
        recording.record(out, c, tmp_path / "runs" / "one", tree)


def test_a_changed_tree_or_seed_fails_the_audit(spark, tree, tmp_path):
    c = config.from_dict({"name": "run", "cycles": 1})
    (tree / "new.txt").write_text("x")
    try:
        recording.record(loop.Outcome(), c, tmp_path / "run", tree)
    finally:
        os.remove(tree / "new.txt")
    found = artifacts.files(spark, str(tmp_path))
    none = provenance.seed_files(found, provenance.materialized(spark, str(tmp_path)))
    assert provenance.audit(found, none).first()["failure_reasons"] == "dirty_package_git;dirty_workspace_git"


def test_sums_and_values_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    record_sink.write_records(records(spark), path, rejected=5, manifest={"mode": "teacher"}, labels={"canonical_labels": ["a"]})
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (m["records"], m["rejected_records"], m["attempted_records"], m["teacher_total_tokens"], m["usage_estimated_records"], m["mode"]) == (50, 5, 55, 250, 1, "teacher")
    assert m["teacher_gold_disagreement_records"] == 13 and m["teacher_gold_disagreement_rate"] == 13 / 50
    back = record_sink.read_records(spark, path, "student_prompt string, note string, teacher_total_tokens int")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, records(spark).select(*back.columns).collect()), key=repr)
    assert json.loads((tmp_path / "out" / "canonical_labels.json").read_text()) == {"canonical_labels": ["a"]}
    assert sum(p["records"] for p in m["parts"]) == 50 and sorted(os.listdir(tmp_path)) == ["out"]


def test_refuses_to_overwrite_and_replaces_when_asked(spark, tmp_path):
    path = str(tmp_path / "out")
    record_sink.write_records(records(spark, 5, 1), path)
    with pytest.raises(Exception, match="already"):
        record_sink.write_records(records(spark, 9, 1), path)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["records"] == 5
    record_sink.write_records(records(spark, 9, 2), path, overwrite=True)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["records"] == 9
    assert len(list((tmp_path / "out").glob("part-*.jsonl"))) == 2 and sorted(os.listdir(tmp_path)) == ["out"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = records(spark).withColumn("note", F.when(F.col("student_prompt") == "q49", F.raise_error(F.lit("broken row"))).otherwise("x"))
    with pytest.raises(Exception, match="broken row"):
        record_sink.write_records(bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_strays_of_other_tries_go_at_commit(tmp_path):
    w = record_sink.RecordWriter({"path": str(tmp_path / "out")}, False)
    os.mkdir(w.staging)
    for n in ("part-00000-1.jsonl", "part-00000-2.jsonl", "part-00000-2.jsonl.manifest.json"):
        open(f"{w.staging}/{n}", "w").close()
    from dataclasses import asdict

    w.commit([record_sink.Part("part-00000-2.jsonl", "s", asdict(record_sink.Sums(records=1)) ), None])
    assert sorted(os.listdir(tmp_path / "out")) == ["manifest.json", "part-00000-2.jsonl", "part-00000-2.jsonl.manifest.json"]


def test_an_empty_table(spark, tmp_path):
    record_sink.write_records(records(spark).limit(0), str(tmp_path / "out"), rejected=3)
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (m["records"], m["attempted_records"], m["parts"]) == (0, 3, [])


def test_canonical_labels(spark):
    rows = spark.createDataFrame([("cash_withdrawal",), (" cash_deposit",), (None,), ("",), ("cash_deposit",)], "label_text string")
    told = recording.canonical_labels(rows=rows, field="label_text")
    assert told["source"] == "dataset field label_text" and told["canonical_labels"] == ["cash_deposit", "cash_withdrawal"]
    named = recording.with_normalised(spark, recording.canonical_labels(class_names=["cash withdrawal", "card-arrival"]))
    assert named["normalized_canonical_labels"] == ["cash_withdrawal", "card_arrival"] and named["canonical_label_count"] == 2
    assert recording.canonical_labels(["A", "B", "A"])["canonical_labels"] == ["A", "B"]
    with pytest.raises(ValueError):
        recording.canonical_labels()
