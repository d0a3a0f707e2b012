"""Gates from run folders: clean folders pass, planted faults fail their check, plans are made and met, commands exit 0 or 1."""

import json
from hashlib import sha256

import pytest
import yaml

from cinderloom import cli
from cinderloom.plans import gate_inputs


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Rows are few and plans long: compiling them would take most of the time."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    for k, x in kept.items():
        spark.conf.set(k, x)


def folder(root, name, policy, control=None, count=3, record_budget=None, final=0.2, space="space-a", config=None, status="completed", attempt=None, heldout=0.2, labels=(4, 4), operator=None, **manifest):
    run = root / name
    run.mkdir(parents=True)
    settings = {"name": name, "policy_name": policy, "seed": 13, "token_budget": 25000, "control_name": control or "", "synthetic_record_budget": record_budget or ""} | (config or {})
    text = yaml.safe_dump(settings, sort_keys=False)
    (run / "experiment_config.yaml").write_text(text)
    (run / "run_manifest.json").write_text(json.dumps({
        "schema_version": 3, "run_id": name, "status": status, "selection_split": "validation", "paper_mode": True, "dataset": "fixture", "dataset_subset": "", "student_model": "m", "student_type": "t", "policy_name": policy, "control_name": control, "seed": 13, "token_budget": 25000,
        "cycles_completed": 2, "expected_cycles": 2, "action_space": {"action_space_id": space}, "synthetic_record_budget": record_budget, "final_synthetic_count": count, "config_hash": sha256(text.encode()).hexdigest(),
    } | manifest))
    last = {"macro_f1": final, "canonical_label_count": labels[1], "observed_gold_label_count": labels[0]}
    (run / "metrics.json").write_text(json.dumps({"0": {"macro_f1": 0.1}, "1": last, "heldout_test": {"macro_f1": heldout, "_heldout_split": "test", "_selection_split": "validation", "canonical_label_count": 4, "observed_gold_label_count": 4}}))
    (run / "token_usage.json").write_text(json.dumps({"grand_total": {"input_tokens": 10, "output_tokens": 5, "total_tokens": 15}, "per_cycle": [{"cycle": 0, "cycle_total": {"total_tokens": 5}}, {"cycle": 1, "cycle_total": {"total_tokens": 10}}]}))
    (run / "policy_decisions.jsonl").write_text(json.dumps({"cycle": 1, "decision_id": f"{name}:d1", "policy_name": policy, "action_name": "augment", "action": {"prompt_operator": operator or "repair"}, "state": {"synthetic_count": count}, "metadata": {}}) + "\n")
    one = {"attempt_id": f"{name}:a1", "decision_id": f"{name}:d1", "run_id": name, "cycle": 0, "status": "success", "predicted_cost": {"total_tokens": 20}, "provider_reported_cost": {"total_tokens": 10}, "ledger_debit_cost": {"total_tokens": 10}, "ledger_debit_source": "provider_reported", "budget_before": {"tokens_remaining": 100}, "budget_after": {"tokens_remaining": 90}, "metadata": {}}
    (run / "teacher_attempts.jsonl").write_text(json.dumps(one | (attempt or {})) + "\n")


EVERY = {"teacher_attempts", "frontier", "heldout", "labels", "paper_mode", "provider_usage", "same_count"}
ARGS = {"metric": "macro_f1", "policies": ["main", "fixed_coverage"], "seeds": ["13"], "budgets": ["25000"], "required": EVERY, "source_policy": "main", "success_policy": "main", "baselines": ["fixed_coverage"], "min_win_rate": {"auc": 0.67, "heldout": 0.67, "final": 0.67}}


def clean(root, **changes):
    """A main run that wins, its fixed baseline and its same-count control; changes by run name."""
    runs = {
        "main": {"policy": "main", "final": 0.9, "heldout": 0.9}, "fixed": {"policy": "fixed_coverage", "operator": "coverage"}, "matched": {"policy": "fixed_coverage", "control": "same_count", "record_budget": 3, "operator": "coverage"},
    }
    for name, args in runs.items():
        folder(root, name, **args | changes.get(name, {}))


def failed(spark, root, **args):
    rows = gate_inputs.pilot_gate(spark, str(root), **ARGS | args).collect()
    return {r["name"] for r in rows if not r["passed"]}, {r["name"] for r in rows}


def test_clean_folders_pass_every_check(spark, tmp_path):
    clean(tmp_path)
    bad, names = failed(spark, tmp_path)
    assert bad == set() and names >= {"same_count_controls_present", "success_policy_beats_same_count_auc", "full_canonical_label_coverage"} and len(names) >= 28


def test_faults_of_runs_and_attempts(spark, tmp_path):
    """Faults whose checks don't touch each other, in one set of folders."""
    attempt = {"ledger_debit_source": "reserved_bound", "status": "failed", "predicted_cost": {"total_tokens": 5}, "budget_after": {"tokens_remaining": 80}}
    clean(tmp_path, main={"labels": (3, 4), "paper_mode": False, "cycles_completed": 3, "attempt": attempt}, fixed={"operator": "repair", "space": "space-b"}, matched={"operator": "repair", "config": {"trainer_config": {"splits": ["train"]}}})
    wanted = {"full_canonical_label_coverage", "paper_mode_enabled", "paper_cycle_bounds", "provider_reported_usage_present", "teacher_attempts_successful", "no_preflight_or_remaining_budget_violations", "budget_feasibility_certificate", "action_space_parity", "fixed_policies_use_distinct_prompt_operators", "same_count_controls_present"}
    assert failed(spark, tmp_path)[0] == wanted


@pytest.mark.parametrize("changes", [{"count": 4}, {"record_budget": 2}, {"space": ""}])
def test_same_count_faults(spark, tmp_path, changes):
    clean(tmp_path, matched=changes)
    t = gate_inputs.gathered(spark, str(tmp_path), metric="macro_f1")
    assert not gate_inputs.same_count_problems(t, "main", None).isEmpty()


def test_runs_that_did_not_complete_and_missing_ones(spark, tmp_path):
    folder(tmp_path, "main", "main", status="failed")
    folder(tmp_path, "fixed", "fixed_coverage", operator="coverage")
    bad, _ = failed(spark, tmp_path, seeds=["13", "42"], required={"paper_mode"}, success_policy=None, only=["paper_runs_completed", "expected_seeds_present", "expected_policy_seed_budget_grid", "paper_mode_enabled"])
    assert bad == {"paper_runs_completed", "expected_seeds_present", "expected_policy_seed_budget_grid"}


def test_plan_is_made_and_met(spark, tmp_path):
    runs, plans = tmp_path / "runs", tmp_path / "runs" / "same_count_configs"
    folder(runs, "main", "main", final=0.9, heldout=0.9, config={"lr": 0.1})
    folder(runs, "fixed", "fixed_coverage", operator="coverage", config={"lr": 0.1})
    made = gate_inputs.plan_same_count(spark, str(runs), output=str(plans), source_policy="main", control_policies=["fixed_boundary", "fixed_coverage"], metric="macro_f1", base_output_dir="out")
    assert [(m["control_policy_name"], m["synthetic_record_budget"], m["match_key"]["seed"]) for m in made] == [("fixed_coverage", 3, "13")]
    config = yaml.safe_load((plans / f"{made[0]['control_experiment_name']}.yaml").read_text())
    assert (config["control_name"], config["synthetic_record_budget"], config["lr"], config["base_output_dir"]) == ("same_count", 3, 0.1, "out")
    args = {"required": {"same_count", "plan"}, "success_policy": None, "only": ["same_count_controls_present"]}
    assert failed(spark, runs, **args)[0] == {"same_count_controls_present"}
    folder(runs, made[0]["control_experiment_name"], "fixed_coverage", "same_count", record_budget=3, operator="coverage", config=config)
    assert failed(spark, runs, **args)[0] == set()
    (plans / "same_count_plan.json").write_text("[{}]")
    assert failed(spark, runs, **args)[0] == {"same_count_controls_present"}


def test_commands(spark, tmp_path, capsys):
    clean(tmp_path / "good")
    base = ["--metric", "macro_f1", "--seeds", "13", "--budgets", "25000"]
    assert cli.main(["pilot-gate", str(tmp_path / "good"), *base, "--policies", "main,absent", "--no-require-frontier"]) == 1
    folder(tmp_path / "scorers", "c1", "main", "scorer_a")
    assert cli.main(["fixed-scorer-gate", str(tmp_path / "scorers"), *base, "--controls", "scorer_a"]) == 0
    assert cli.main(["plan-same-count-controls", str(tmp_path / "good"), "--metric", "macro_f1", "--output", str(tmp_path / "plan"), "--source-policy", "main", "--control-policies", "fixed_coverage"]) == 0
    assert "1 control configurations" in capsys.readouterr().out
