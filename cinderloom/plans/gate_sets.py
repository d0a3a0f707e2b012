"""The three gates as named sets of checks: paper (tables of a report), fixed scorer and pilot (tables of runs).

Each check is a DataFrame of violations, so a whole gate is one plan that ``gates.report`` counts.
A check that asks for rows has one violation where there are none. A table of a report that is
missing counts as empty, and as missing in the first check. Blank text counts as null in names.

Runs have run_id, policy, control, seed, budget, status, paper_mode, cycles_completed,
expected_cycles, estimated_rows, heldout_split, heldout_metric, auc, final, ledger_total, decisions
(their number), action_space, labels, labels_expected, heldout_labels, heldout_labels_expected and
the match keys. Attempts have run_id, attempt_id, decision_id, status, predicted, ledger, provider,
before and debit_source; decisions have decision_id, policy_name, operator, is_stop and outcome.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.operators import comparison as cmp
from cinderloom.operators import gates, ledger
from cinderloom.plans import same_count

METRICS = ("auc", "heldout", "final")
#: Tables of a report and the columns that the paper gate reads.
REPORT = {
    "main_results": "policy string",
    "pairwise_deltas": "baseline_policy string, baseline_control string, delta_seed double",
    "pairwise_summary": "baseline_policy string, baseline_control string, budget string, " + ", ".join(f"{m}_n long, {m}_win_rate double, {m}_mean_delta double" for m in METRICS),
    "budget_audit": "max_overage double, over_preflight_rows long, over_remaining_rows long, violation_rows long, parse_failure_rows long, failed_rows long, masked_rows long, missing_provider_rows long, estimated_rows long",
    "certificates": "certificate_passed boolean",
    "provenance": "passed boolean, package_head_sha string, workspace_head_sha string, pyproject_sha256 string, uv_lock_sha256 string",
    "synthetic_quality": "dataset_persisted boolean",
    "synthetic_labels": "label string",
    "same_count": "label string",
}
#: The operator of each fixed policy, and the outcomes of a decision that dispatched a teacher.
FIXED_OPERATORS = {"fixed_coverage": "coverage", "fixed_boundary": "boundary", "fixed_repair": "repair"}
ACQUIRED = ("augment", "augment_empty", "augment_failed", "budget_masked")


def any_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, [f.select(F.lit(1).alias("violation")) for f in frames])


def failing(ok: Column) -> Column:
    """Not true: null fails."""
    return ~F.coalesce(ok, F.lit(False))


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _absent(rows: DataFrame, column: str, names) -> DataFrame:
    return gates.missing_values(rows, column, list(names)) if names else rows.limit(0)


def paper_gate(spark: SparkSession, tables: dict[str, DataFrame], *, baselines=(), reported=(), controls=(), min_win_rate: dict[str, float] = {}, min_delta: dict[str, float] = {}, seed_tolerance: float | None = 1e-9, provider_usage: bool = True, required_figures=None) -> dict[str, DataFrame]:
    """Checks of a report. required_figures: prefixes of names in table figures (name, bytes); None asks for no figures."""
    t = {k: tables[k] if k in tables else spark.createDataFrame([], schema) for k, schema in REPORT.items()}
    lost = [k for k in (*REPORT, *(["figures"] if required_figures is not None else [])) if k not in tables]
    total = t["pairwise_summary"].where("budget = 'ALL'")
    named = F.coalesce(F.col("baseline_policy").isin(list(baselines)), F.lit(False)) | F.coalesce(F.col("baseline_control").isin(list(controls)), F.lit(False))
    compared = total.where(named)
    short = [(F.col(f"{m}_n") > 0) & (F.col(f"{m}_win_rate") >= rate) & (F.col(f"{m}_mean_delta") >= min_delta.get(m, 0.0)) for m, rate in min_win_rate.items()]
    below = compared.where(reduce(Column.__or__, [failing(ok) for ok in short])) if short else compared.limit(0)
    compare = [below, gates.empty(compared)] if baselines or controls else [below]
    seeds = t["pairwise_deltas"].where(named & failing(F.abs("delta_seed") <= seed_tolerance)) if seed_tolerance is not None else total.limit(0)
    b = t["budget_audit"]
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    spent = [count(c) > 0 for c in ("max_overage", "over_preflight_rows", "over_remaining_rows", "violation_rows", "parse_failure_rows")] + [count("failed_rows") > count("masked_rows")]
    spent += [count(c) > 0 for c in ("missing_provider_rows", "estimated_rows")] if provider_usage else []
    p = t["provenance"]
    shas = [gates.inconsistent(p, c) for c in ("package_head_sha", "workspace_head_sha", "pyproject_sha256", "uv_lock_sha256")]
    checks = {
        "paper_gate_required_artifacts_present": spark.createDataFrame([(x,) for x in lost], "name string"),
        "paper_main_results_nonempty": gates.empty(t["main_results"]),
        "paper_required_baselines_present": any_of(_absent(total, "baseline_policy", [*baselines, *reported]), _absent(total, "baseline_control", controls)),
        "paper_required_comparisons_pass": any_of(*compare),
        "paper_shared_seed_baselines_match": seeds,
        "paper_budget_feasibility_certificates_pass": any_of(gates.empty(t["certificates"]), t["certificates"].where(failing(F.col("certificate_passed")))),
        "paper_budget_audit_passes": any_of(gates.empty(b), b.where(reduce(Column.__or__, spent))),
        "paper_provenance_audit_passes": any_of(gates.empty(p), p.where(failing(F.col("passed")))),
        "paper_provenance_consistent_across_runs": any_of(gates.empty(p), *shas),
        "paper_synthetic_quality_audit_passes": any_of(gates.empty(t["synthetic_quality"]), t["synthetic_quality"].where(failing(F.col("dataset_persisted")))),
        "paper_synthetic_label_distribution_present": gates.empty(t["synthetic_labels"]),
        "paper_same_count_distribution_present": gates.empty(t["same_count"]) if "same_count" in controls else t["same_count"].limit(0),
    }
    if required_figures is not None:
        made = tables["figures"] if "figures" in tables else spark.createDataFrame([], "name string, bytes long")
        prefixes = spark.createDataFrame([(x,) for x in required_figures], "prefix string")
        # The beginnings of each name, so that prefixes meet them by equality.
        beginnings = made.where("length(name) > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", F.lit(1), i))).alias("prefix"))
        undrawn = prefixes.join(beginnings, "prefix", "left_anti")
        checks["paper_required_figures_present"] = any_of(undrawn, made.where(failing(F.col("bytes") > 0)), *([] if "figures" in tables else [prefixes.sparkSession.range(1)]))
    return checks


def _grid(runs: DataFrame, **axes: list) -> DataFrame:
    """Combinations that are missing, not expected or repeated; none if an axis is empty."""
    if not all(axes.values()):
        return runs.limit(0)
    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in axes)
    expected = runs.sparkSession.createDataFrame(list(product(*axes.values())), kinds)
    return any_of(cmp.grid_gaps(expected, runs.select(*axes)), cmp.duplicate_groups(runs, list(axes)))


def _unreported(attempts: DataFrame) -> DataFrame:
    """Dispatched attempts without the provider's usage, or whose debit is not the provider's."""
    dispatched = F.coalesce(F.col("status") != "masked", F.lit(True))
    return attempts.where(dispatched & (F.col("provider").isNull() | failing(F.col("debit_source") == "provider_reported")))


def fixed_scorer_gate(runs: DataFrame, attempts: DataFrame, certificates: DataFrame, *, controls: list, seeds: list, budgets: list) -> dict[str, DataFrame]:
    unexpected = runs.where(~_blank("control") & ~F.col("control").isin(list(controls)))
    return {
        "fixed_scorer_controls_present": any_of(_absent(runs, "control", controls), unexpected),
        "fixed_scorer_control_seed_budget_grid": _grid(runs, control=controls, seed=seeds, budget=budgets),
        "fixed_scorer_runs_completed": gates.not_completed(runs),
        "fixed_scorer_paper_mode_enabled": gates.not_paper_mode(runs),
        "fixed_scorer_heldout_test_metrics_present": gates.heldout_missing(runs),
        "fixed_scorer_no_estimated_seed_usage": gates.estimated_usage(runs),
        "fixed_scorer_provider_reported_usage_present": _unreported(attempts),
        "fixed_scorer_no_token_budget_overage": gates.over_budget(runs),
        "fixed_scorer_budget_feasibility_certificate": certificates.where(failing(F.col("certificate_passed"))),
    }


def _wrong_operators(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fixed policies that ran and whose decisions used any operators but their own."""
    expected = F.create_map(*[F.lit(x) for pair in FIXED_OPERATORS.items() for x in pair])
    ran = runs.select(F.col("policy").alias("policy_name")).where(F.col("policy_name").isin(list(FIXED_OPERATORS))).distinct()
    acted = decisions.where(~F.coalesce(F.col("is_stop"), F.lit(False)) & F.coalesce(F.lower("outcome") != "stop", F.lit(True)) & ~_blank("operator"))
    used = acted.groupBy("policy_name").agg(F.collect_set("operator").alias("used"))
    return ran.join(used, "policy_name", "left").where(~F.col("used").eqNullSafe(F.array(F.try_element_at(expected, F.col("policy_name")))))


def _labels_missing(runs: DataFrame) -> DataFrame:
    seen, known = F.col("heldout_labels"), F.col("heldout_labels_expected")
    held = (~_blank("heldout_split") | known.isNotNull()) & failing(seen == known)
    return runs.where(failing(F.col("labels") == F.col("labels_expected")) | held)


def pilot_gate(
    runs: DataFrame, attempts: DataFrame, decisions: DataFrame, certificates: DataFrame, *, keys: list[str], policies=(), seeds=(), budgets=(), fixed: Column | None = None, success_policy: str | None = None,
    baselines=(), controls=("same_count",), planned: DataFrame | None = None, min_win_rate: dict[str, float] = {}, min_delta: dict[str, float] = {},
) -> dict[str, DataFrame]:
    """Checks of runs that meet by ``keys``. planned: the same-count plan (keys, control_policy, synthetic_record_budget).

    Same-count controls are compared as one baseline, whatever policy they ran.
    """
    is_control = F.coalesce(F.col("control").isin(list(controls)), F.lit(False))
    own, matched = runs.where(~is_control), runs.where(is_control)
    fixed = F.col("policy").isin(list(FIXED_OPERATORS)) if fixed is None else fixed
    known = attempts.where(~_blank("decision_id"))
    over = ledger.calibration(attempts).where("over_preflight or over_remaining")
    checks = {
        "expected_policies_present": _absent(own, "policy", policies),
        "expected_seeds_present": _absent(own, "seed", seeds),
        "expected_budgets_present": _absent(own, "budget", budgets),
        "expected_policy_seed_budget_grid": _grid(own, policy=list(policies), seed=list(seeds), budget=list(budgets)),
        "action_space_parity": cmp.action_space_parity(own, keys, "action_space").where("not parity"),
        "paper_runs_completed": gates.not_completed(runs),
        "paper_mode_enabled": gates.not_paper_mode(runs),
        "paper_cycle_bounds": gates.cycles_out_of_bounds(runs),
        "no_estimated_seed_usage": gates.estimated_usage(runs),
        "teacher_attempts_successful": attempts.where(failing(F.col("status").isin("success", "masked"))),
        "provider_reported_usage_present": _unreported(attempts),
        "no_token_budget_overage": gates.over_budget(runs),
        "policy_decisions_present": runs.where(failing(F.col("decisions") > 0)),
        "fixed_policies_use_distinct_prompt_operators": _wrong_operators(runs, decisions),
        "teacher_attempts_join_policy_decisions": any_of(attempts.where(_blank("decision_id")), gates.unmatched(known, decisions, "decision_id")),
        "acquisition_decisions_have_teacher_attempts": gates.unmatched(decisions.where(~_blank("decision_id") & F.col("outcome").isin(*ACQUIRED)), known, "decision_id"),
        "teacher_attempts_present": gates.empty(attempts),
        "no_preflight_or_remaining_budget_violations": over,
        "budget_feasibility_certificate": certificates.where(failing(F.col("certificate_passed"))),
        "fixed_policy_frontier_available": gates.unavailable_frontier(cmp.oracle_frontier(own, keys, "final", fixed)),
        "heldout_test_metrics_present": gates.heldout_missing(runs),
        "full_canonical_label_coverage": _labels_missing(runs),
    }
    value = {"auc": "auc", "heldout": "heldout_metric", "final": "final"}
    against = lambda rows, names, m: cmp.success_check(rows, keys, value[m], success_policy, list(names), min_win_rate[m], min_delta.get(m, 0.0)).where("not passed")
    if success_policy and baselines:
        checks |= {f"success_policy_beats_baselines_{m}": against(own, baselines, m) for m in METRICS if m in min_win_rate}
    if planned is not None:
        source = own.where(F.col("policy") == success_policy) if success_policy else own.limit(0)
        odd = cmp.null_safe(matched, planned.select(*keys, "control_policy"), keys).where(~F.col("policy").eqNullSafe(F.col("control_policy")))
        checks["same_count_controls_present"] = any_of(same_count.reconcile(planned, matched, keys).where("problem is not null"), cmp.grid_gaps(source.select(*keys).distinct(), planned), odd)
        one = own.where(F.col("policy") == success_policy).unionByName(matched.withColumn("policy", F.lit("same_count"))) if success_policy else own
        checks |= {f"success_policy_beats_same_count_{m}": against(one, ["same_count"], m) for m in METRICS if success_policy and m in min_win_rate}
    return checks
