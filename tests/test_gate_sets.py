"""All 51 checks of the three gates: clean tables pass each, and a fault planted for a check fails it."""

import pytest

from cinderloom.operators import gates
from cinderloom.plans import gate_sets


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Rows are few and plans long: compiling them would take most of the time."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    for k, x in kept.items():
        spark.conf.set(k, x)


RUN = "run_id string, policy string, control string, seed int, budget long, status string, paper_mode boolean, cycles_completed int, expected_cycles int, estimated_rows int, heldout_split string, heldout_metric double, auc double, final double, ledger_total double, decisions int, action_space string, labels int, labels_expected int, heldout_labels int, heldout_labels_expected int, synthetic_count int"
ATTEMPT = "run_id string, attempt_id string, decision_id string, status string, predicted double, ledger double, provider double, before double, debit_source string"
DECISION = "decision_id string, policy_name string, operator string, is_stop boolean, outcome string"
COLUMNS = [c.split()[0] for c in RUN.split(", ")]


def run(run_id, policy, control, score):
    return dict(zip(COLUMNS, [run_id, policy, control, 0, 100, "completed", True, 2, 2, 0, "test", score, score, score, 10.0, 1, "all", 3, 3, 3, 3, 5], strict=True))


def failed(checks):
    return {r.name for r in gates.report(checks).collect() if not r.passed}


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) if isinstance(r, dict) else r for r in rows], schema)


RUNS = [run("r1", "linear", None, 0.9), run("r2", "fixed_coverage", None, 0.5), run("r3", "fixed_coverage", "same_count", 0.4)]
ATTEMPTS = [("r1", "a1", "d1", "success", 10.0, 5.0, 5.0, 100.0, "provider_reported")]
DECISIONS = [("d1", "linear", "repair", False, "augment"), ("d2", "fixed_coverage", "coverage", False, "skipped")]
RATE = {m: 0.67 for m in gate_sets.METRICS}


def pilot(spark, runs=RUNS, attempts=ATTEMPTS, decisions=DECISIONS, certificate=True, plan=((0, 100, "fixed_coverage", 5),), **kw):
    tables = frame(spark, runs, RUN), frame(spark, attempts, ATTEMPT), frame(spark, decisions, DECISION), spark.createDataFrame([(certificate,)], "certificate_passed boolean")
    planned = spark.createDataFrame(list(plan), "seed int, budget long, control_policy string, synthetic_record_budget int")
    args = {"policies": ["linear", "fixed_coverage"], "seeds": [0], "budgets": [100], "baselines": ["fixed_coverage"]} | kw
    return gate_sets.pilot_gate(*tables, keys=["seed", "budget"], success_policy="linear", planned=planned, min_win_rate=RATE, **args)


def changed(i, **kw):
    return [r | kw if j == i else r for j, r in enumerate(RUNS)]


def attempt(**kw):
    return [dict(zip([c.split()[0] for c in ATTEMPT.split(", ")], ATTEMPTS[0], strict=True)) | kw]


def test_pilot_gate_passes(spark):
    checks = pilot(spark)
    assert len(checks) == 29 and failed(checks) == set()


GRID = {"expected_policies_present", "expected_seeds_present", "expected_budgets_present", "expected_policy_seed_budget_grid"}
STATE = {"action_space_parity", "paper_runs_completed", "paper_mode_enabled", "paper_cycle_bounds", "no_estimated_seed_usage", "no_token_budget_overage", "policy_decisions_present", "full_canonical_label_coverage"}
BEATS = {f"success_policy_beats_{x}_{m}" for x in ("baselines", "same_count") for m in gate_sets.METRICS}
TRIES = {"teacher_attempts_successful", "provider_reported_usage_present", "no_preflight_or_remaining_budget_violations"}
OPERATORS, PLAN = "fixed_policies_use_distinct_prompt_operators", "same_count_controls_present"
STATES = [RUNS[0] | {"ledger_total": 101.0, "decisions": None, "heldout_labels": None}, RUNS[1] | {"action_space": "few", "status": None, "paper_mode": None, "cycles_completed": 3, "estimated_rows": 1}, RUNS[2]]


@pytest.mark.parametrize(
    "names, kw",
    [
        (GRID | {OPERATORS, "budget_feasibility_certificate", PLAN}, {"policies": ["linear", "absent"], "seeds": [0, 1], "budgets": [100, 200], "decisions": [*DECISIONS, ("d3", "fixed_coverage", "repair", False, "skipped")], "certificate": None, "plan": ((0, 100, "fixed_coverage", 6),)}),
        (STATE | TRIES | {PLAN}, {"runs": STATES, "attempts": attempt(status="failed", provider=None, ledger=11.0), "plan": ((0, 100, "linear", 5),)}),
        ({"heldout_test_metrics_present", "full_canonical_label_coverage", "provider_reported_usage_present", OPERATORS, PLAN}, {"runs": changed(0, heldout_split="validation", labels=2), "attempts": attempt(debit_source="estimated"), "decisions": DECISIONS[:1], "plan": ()}),
        (BEATS | {"teacher_attempts_join_policy_decisions", "acquisition_decisions_have_teacher_attempts"}, {"runs": changed(0, auc=0.1, heldout_metric=0.1, final=0.1), "attempts": attempt(decision_id="d9")}),
        ({"teacher_attempts_present", "acquisition_decisions_have_teacher_attempts"}, {"attempts": []}),
    ],
)
def test_pilot_gate_fails(spark, names, kw):
    assert failed(pilot(spark, **kw)) == names


def test_frontier_needs_a_fixed_run(spark):
    assert "fixed_policy_frontier_available" in failed(pilot(spark, runs=changed(1, policy="other")))


def test_fixed_scorer_gate(spark):
    def gate(runs, attempts=ATTEMPTS, passed=True):
        return gate_sets.fixed_scorer_gate(frame(spark, runs, RUN), frame(spark, attempts, ATTEMPT), spark.createDataFrame([(passed,)], "certificate_passed boolean"), controls=["s1", "s2"], seeds=[0], budgets=[100])

    good = [run("r1", "p", "s1", 0.5), run("r2", "p", "s2", 0.5)]
    assert len(gate(good)) == 9 and failed(gate(good)) == set()
    assert failed(gate([*good, run("r3", "p", "s1", 0.5)])) == {"fixed_scorer_control_seed_budget_grid"}
    bad = [good[0], good[1] | {"control": "s3", "status": "failed", "paper_mode": False, "heldout_metric": None, "estimated_rows": 2, "ledger_total": 200.0}]
    assert failed(gate(bad, attempt(provider=None), False)) == set(gate(good))


def test_paper_gate(spark):
    rows = {
        "main_results": [("p",)], "pairwise_deltas": [("b", None, 0.0)], "pairwise_summary": [("b", "same_count", "ALL", *[3, 1.0, 0.1] * 3), ("b", None, "100", *[0, 0.0, -1.0] * 3)], "budget_audit": [(0.0, 0, 0, 0, 0, 1, 1, 0, None)], "certificates": [(True,)],
        "provenance": [(True, "a", "b", "c", ""), (True, "a", "b", "c", "d")], "synthetic_quality": [(True,)], "synthetic_labels": [("x",)], "same_count": [("x",)],
    }
    figures = spark.createDataFrame([("curve.png", 5)], "name string, bytes long")

    def gate(figures=figures, **kw):
        tables = {k: spark.createDataFrame(v, gate_sets.REPORT[k]) for k, v in (rows | kw).items() if v is not None}
        return gate_sets.paper_gate(spark, tables | ({"figures": figures} if figures else {}), baselines=["b"], controls=["same_count"], min_win_rate=RATE, required_figures=["curve"])

    assert len(gate()) == 13 and failed(gate()) == set()
    assert failed(gate(figures=None, **dict.fromkeys(rows))) == set(gate()) - {"paper_shared_seed_baselines_match"}
    assert failed(gate(pairwise_deltas=[("b", None, None), ("z", None, 9.0)])) == {"paper_shared_seed_baselines_match"}
    assert failed(gate(provenance=[(True, "a", "", "", ""), (False, "b", "", "", "")])) == {"paper_provenance_audit_passes", "paper_provenance_consistent_across_runs"}
    assert failed(gate(budget_audit=[(0.0, 0, 0, 0, 0, 2, 1, 0, 0)])) == {"paper_budget_audit_passes"}
    assert failed(gate(pairwise_summary=[("b", "same_count", "ALL", *[3, 0.5, 0.1] * 3)])) == {"paper_required_comparisons_pass"}
    empty = spark.createDataFrame([("curve.png", 0)], "name string, bytes long")
    assert failed(gate(figures=empty)) == {"paper_required_figures_present"}
