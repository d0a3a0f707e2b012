import pytest
from pyspark.sql import functions as F

from cinderloom.functions import prompts
from cinderloom.operators import config, loop, report, run_summary
from cinderloom.operators.students import HashedLogistic
from cinderloom.plans import same_count
from tests.test_golden import make_run


def test_grid_and_shards():
    c = config.from_dict({"name": "e", "policy_name": ["a", "b", "c"], "token_budget": [10, 20], "early_stopping": {"enabled": True, "metric": "f1"}, "dataset_kwargs": {"data_files": {"train": ["x", "y"], "test": "z"}}})
    every = config.grid(c)
    assert [e.name for e in every][:2] == ["e_policy_name-a_token_budget-10", "e_policy_name-a_token_budget-20"] and len(every) == 6
    parts = [config.shard(every, i, 4) for i in range(4)]
    assert sorted(e.name for p in parts for e in p) == sorted(e.name for e in every)
    assert config.data_files(c) == ["x", "y", "z"] and config.value_name(0.0001) == "1e-04"
    for bad in ({"name": "a b"}, {"name": "a", "token_budget": -1}, {"name": "a", "early_stopping": {"enabled": True, "metric": "zzz"}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    with pytest.raises(ValueError):
        config.shard(every, 4, 4)


def test_attempt_outcome(spark):
    rows = [(10.0, 20.0, True, "r", 1, 13.0, "masked", 0.0, "zero_no_dispatch"), (100.0, 20.0, True, "r", 1, 13.0, "success", 13.0, "provider_reported"), (100.0, 20.0, True, "r", 0, None, "empty_response", 20.0, "reserved_bound"), (100.0, 20.0, True, None, 0, None, "failed", 20.0, "reserved_bound"), (None, 20.0, False, "r", 1, 13.0, "budget_violation", 0.0, "zero_no_dispatch")]
    df = spark.createDataFrame(rows, "b double, p double, ok boolean, reply string, acc int, rep double, status string, ledger double, source string")
    for r in df.withColumn("o", loop.attempt_outcome(F.col("b"), F.col("p"), F.col("ok"), F.col("reply"), F.col("acc"), F.col("rep"))).collect():
        assert (r.o.status, r.o.ledger, r.o.source) == (r.status, r.ledger, r.source)


def test_cycle_loop(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} text {i % 7}", i % 2) for i in range(40)], "id long, text string, class_id int")

    def teacher(wrong, n):
        return spark.createDataFrame([(1000 + i, "good fine words", 1) for i in range(n)], "id long, text string, class_id int"), 13

    c = config.from_dict({"name": "run", "cycles": 3, "token_budget": 100_000, "policy_name": "fixed_repair"})
    out = loop.run(c, rows, rows, HashedLogistic(64, 5), teacher, str(tmp_path))
    assert list(out.metrics) == [0, 1, 2] and out.spent == 26 and out.stop_cause == "cycles" and out.metrics[2]["accuracy"] > 0.9
    assert spark.read.parquet(str(tmp_path / "run" / "dataset_cycle_2")).count() == 72
    assert out.rows(spark, "attempts").count() == 2
    early = config.from_dict({"name": "stop", "cycles": 9, "policy_name": "student_only", "early_stopping": {"enabled": True, "patience": 1}})
    assert loop.run(early, rows, rows, HashedLogistic(64, 2), teacher, str(tmp_path)).stop_cause == "policy"
    told = loop.sweep([c, early], lambda e: loop.Outcome(stop_cause="budget") if e is c else 1 / 0)
    assert len(told) == 1


def test_prompts(spark):
    df = spark.createDataFrame([(1, "a", "x"), (0, "b", "y")], "idx int, text string, label string")
    assert prompts.sample_block(df).first().block.startswith("1. b\n   label: y\n2. a")
    reply = spark.createDataFrame([('{"records": [{"student_prompt": "p", "teacher_response": "r"}]}',), ("broken",)], "r string").select(F.size(prompts.parsed_records(F.col("r"))).alias("n"))
    assert [r.n for r in reply.collect()] == [1, 0]


def test_report(spark, tmp_path):
    make_run(tmp_path / "r1", "one")
    make_run(tmp_path / "r2", "two", values=(0.1, 0.4))
    names = report.write(spark, str(tmp_path / "out"), str(tmp_path), success_policy="p", baselines=["p"])
    assert "summary" in names and all(list((tmp_path / "out" / n).glob("*.csv")) for n in names)
    assert run_summary.summarize(spark, str(tmp_path)).count() == 2


def test_same_count_plan(spark):
    runs = spark.createDataFrame([(1, "d", 1, "src", "", 0.5, 10), (2, "d", 1, "fixed_a", "", 0.7, 5), (3, "d", 1, "fixed_b", "", 0.6, 5), (4, "e", None, "src", "", 0.5, 7)], "run_id int, dataset string, seed int, policy string, control string, final double, synthetic_count int")
    plan = same_count.plan(runs, ["dataset", "seed"], "src", ["fixed_a", "fixed_b"])
    got = {r.source_run: r.control_policy for r in plan.collect()}
    assert got == {1: "fixed_a", 4: None}
    controls = spark.createDataFrame([("d", 1, 9), ("z", 1, 1)], "dataset string, seed int, synthetic_count int")
    assert {r.problem for r in same_count.reconcile(plan, controls, ["dataset", "seed"]).collect()} == {"count_mismatch", "missing", "unplanned"}
