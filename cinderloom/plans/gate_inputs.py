"""Gates over run folders: the tables that ``gate_sets`` checks, gathered from artifacts, and the same-count plan.

All runs below the roots are one scan of their files; every table here is a DataFrame over it, and
a gate is one plan whose result is a row a check. What the driver writes is the plan: a few
configuration files, one for each control run to be made.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.operators import comparison as cmp
from cinderloom.operators import gates, provenance
from cinderloom.operators.ledger import budget_certificate
from cinderloom.operators.run_summary import summarize
from cinderloom.plans import gate_sets, same_count
from cinderloom.sources import artifacts
from cinderloom.sources.staging import staged

#: The columns by which runs meet, the plan's names of them where they differ, and the keys in which a control's configuration may differ from its source's.
MATCH = ["dataset", "dataset_subset", "student_model", "student_type", "seed", "budget", "selection_split", "metric", "mode"]
PLAN_NAMES = {"budget": "token_budget"}
VOLATILE = ["base_output_dir", "control_name", "name", "policy_name", "synthetic_record_budget"]
CONTROL = "same_count"
PLAN_FILE = "same_count_plan.json"
#: Checks that a gate holds only where they are asked for.
OPTIONAL = {
    "teacher_attempts": ("teacher_attempts_present",), "frontier": ("fixed_policy_frontier_available",), "heldout": ("heldout_test_metrics_present", "fixed_scorer_heldout_test_metrics_present"), "labels": ("full_canonical_label_coverage",),
    "paper_mode": ("paper_runs_completed", "paper_mode_enabled", "paper_cycle_bounds", "fixed_scorer_runs_completed", "fixed_scorer_paper_mode_enabled"),
    "provider_usage": ("no_estimated_seed_usage", "provider_reported_usage_present", "fixed_scorer_no_estimated_seed_usage", "fixed_scorer_provider_reported_usage_present"),
}


@dataclass
class Inputs:
    runs: DataFrame
    attempts: DataFrame
    decisions: DataFrame
    certificates: DataFrame
    configs: DataFrame  # run_id, config (JSON text)


def _inner(doc: Column, *keys: str) -> Column:
    """The value below nested keys of a document, as text; blank is null."""
    for i, k in enumerate(keys):
        doc = F.try_element_at(F.from_json(doc, "map<string,string>") if i else doc, F.lit(k))
    return F.nullif(F.trim(doc), F.lit(""))


def gathered(spark: SparkSession, *roots: str, metric: str | None = None, mode: str = "auto", seed_usage: bool = False) -> Inputs:
    """The tables of a gate. Runs are known by their folders; runs that did not complete are there, without metrics. seed_usage: count estimated seed records in the manifests below the roots."""
    every = artifacts.files(spark, *roots)
    found = every.join(artifacts.run_dirs(every), "dir")
    told = summarize(spark, *roots, metric=metric, mode=mode, strict=False).select("dir", "metric", "mode", F.col("final_metric").alias("final"), F.col("total_teacher_quality_cost_auc").alias("auc"), "heldout_metric", F.col("online_tokens").cast("double").alias("ledger_total"))
    doc = F.col("doc")
    said = artifacts.documents(found, "run_manifest.json").select("dir", _inner(doc, "action_space", "action_space_id").alias("action_space"), _inner(doc, "final_synthetic_count").try_cast("long").alias("_count"))
    lines = artifacts.log(found, "policy_decisions.jsonl", artifacts.DECISION + ", state struct<synthetic_count:long>")
    last = lines.groupBy("dir").agg(F.count("*").cast("int").alias("decisions"), F.max_by("state.synthetic_count", F.when(F.col("state.synthetic_count").isNotNull(), F.col("ord"))).alias("_logged"))
    held = artifacts.heldout(found).select("dir", artifacts.text(F.col("heldout"), "_heldout_split").alias("heldout_split"), *[artifacts.text(F.col("heldout"), k).try_cast("long").alias(c) for k, c in (("observed_gold_label_count", "heldout_labels"), ("canonical_label_count", "heldout_labels_expected"))])
    cycles = artifacts.cycle_metrics(found)
    at = lambda name: F.max_by(F.when(F.col("metric") == name, F.col("value")), F.struct("cycle", (F.col("metric") == name).cast("int"))).cast("long")
    labels = cycles.groupBy("dir").agg(at("observed_gold_label_count").alias("labels"), at("canonical_label_count").alias("labels_expected"))
    rows = artifacts.contexts(found).withColumnRenamed("policy_name", "policy").withColumnRenamed("control_name", "control").withColumn("budget", F.col("token_budget").cast("long")).withColumn("run", F.coalesce("run_id", "dir"))
    for part in (told, said, last, held, labels):
        rows = rows.join(part, "dir", "left")
    if seed_usage:
        seeds = provenance.seed_files(found, provenance.materialized(spark, *roots))
        rows = rows.join(provenance.seed_tokens(found, seeds).select("dir", F.col("estimated_records").alias("estimated_rows")), "dir", "left")
    else:
        rows = rows.withColumn("estimated_rows", F.lit(0))
    runs = rows.drop("run_id").withColumnRenamed("dir", "run_id").withColumn("synthetic_count", F.coalesce("_count", "_logged")).drop("_count", "_logged")
    tries = artifacts.attempts(found).join(artifacts.log(found, "teacher_attempts.jsonl", artifacts.ATTEMPT).select(F.col("dir").alias("run_id"), "ord", F.col("ledger_debit_source").alias("debit_source")), ["run_id", "ord"])
    decisions = lines.select(F.col("dir").alias("run_id"), "decision_id", "policy_name", F.col("action.prompt_operator").alias("operator"), F.col("action.is_stop").alias("is_stop"), F.coalesce("metadata.acquisition_outcome", "action_name").alias("outcome"))
    configs = found.where("name = 'experiment_config.yaml'").select(F.col("dir").alias("run_id"), artifacts.yaml_as_json(F.col("content")).alias("config"))
    # Every check reads these tables: written once, a check's plan starts at rows and not at the files' parsing.
    runs, tries = staged(runs), staged(tries)
    return Inputs(runs, tries, staged(decisions), staged(budget_certificate(tries, runs.select("run_id", "budget"))), staged(configs))


def read_plan(spark: SparkSession, path: str) -> DataFrame | None:
    """The same-count plan: match columns, control_name, control_policy, synthetic_record_budget; None where there is no file or it is no list of items with keys."""
    there = artifacts.first_existing(spark, path)
    if there is None:
        return None
    item = f"struct<control_experiment_name:string,control_policy_name:string,synthetic_record_budget:long,match_key:struct<{','.join(f'{PLAN_NAMES.get(k, k)}:string' for k in MATCH)}>>"
    rows = spark.read.text(there, wholetext=True).select(F.from_json("value", f"array<{item}>", {"mode": "PERMISSIVE"}).alias("items"))
    bad = rows.where("items is null or exists(items, x -> x is null or x.match_key is null)")
    if not bad.isEmpty():
        return None
    return rows.select(F.explode("items").alias("i")).select(*[_key(F.col(f"i.match_key.{PLAN_NAMES.get(k, k)}"), k) for k in MATCH], F.col("i.control_experiment_name").alias("control_name"), F.col("i.control_policy_name").alias("control_policy"), "i.synthetic_record_budget")


def _key(value: Column, name: str) -> Column:
    """A match column as it is compared: text without null, the budget a number."""
    return (value.try_cast("double").cast("long") if name == "budget" else F.coalesce(value.cast("string"), F.lit(""))).alias(name)


def same_count_problems(t: Inputs, source_policy: str, planned: DataFrame | None, control_policy: str | None = None) -> DataFrame:
    """Problems of the same-count controls against the plan (each source's key, if there is none) and the source runs."""
    keyed = t.runs.select(*[_key(F.col(k), k) for k in MATCH], "run_id", "experiment", "policy", "control", "action_space", "synthetic_count", "synthetic_record_budget").join(t.configs, "run_id", "left")
    is_control = F.coalesce(F.col("control") == CONTROL, F.lit(False))
    columns = [*MATCH, "run_id", "experiment", "policy", "action_space", "synthetic_count", "config"]
    controls, sources = keyed.where(is_control), keyed.where(~is_control & (F.col("policy") == source_policy)).select(*columns)
    wanted = planned if planned is not None else sources.select(*MATCH, F.lit(None).cast("string").alias("control_name"), F.lit(control_policy).cast("string").alias("control_policy"), F.col("synthetic_count").alias("synthetic_record_budget"))
    # A control made as many records as it was allowed.
    short = controls.where(~F.col("synthetic_count").eqNullSafe(F.col("synthetic_record_budget").cast("long"))).select("run_id", F.lit("budget_mismatch").alias("problem"))
    controls, sources, wanted = staged(controls), staged(sources), staged(wanted)
    found = same_count.reconcile_runs(wanted, controls.select(*columns), sources, MATCH, VOLATILE).select("run_id", "problem")
    unmet = cmp.null_safe(sources, planned.select(*MATCH).distinct().withColumn("_p", F.lit(True)), MATCH, "left").where("_p is null").select("run_id", F.lit("source_without_plan").alias("problem")) if planned is not None else found.limit(0)
    return found.unionByName(short).unionByName(unmet)


def _kept(checks: dict[str, DataFrame], required: set[str]) -> dict[str, DataFrame]:
    off = {name for option, names in OPTIONAL.items() if option not in required for name in names}
    return {k: c for k, c in checks.items() if k not in off}


def _text_runs(t: Inputs) -> DataFrame:
    return t.runs.withColumns({k: _key(F.col(k), k) for k in MATCH})


def pilot_gate(
    spark: SparkSession, *roots: str, metric: str | None = None, mode: str = "auto", policies=(), seeds=(), budgets=(), required: set[str] = frozenset({"teacher_attempts", "frontier"}), source_policy: str | None = None, plan_path: str | None = None,
    control_policy: str | None = None, success_policy: str | None = None, baselines=(), min_win_rate: dict[str, float] | None = None, min_delta: dict[str, float] | None = None, only=(),
) -> DataFrame:
    """name, passed, violations of each check (or only of those named). required: of teacher_attempts, frontier, heldout, labels, paper_mode, provider_usage, same_count, plan."""
    t = gathered(spark, *roots, metric=metric, mode=mode, seed_usage="provider_usage" in required)
    rate, delta = min_win_rate or {}, min_delta or {}
    rows = _text_runs(t)
    checks = gate_sets.pilot_gate(rows, t.attempts, t.decisions, t.certificates, keys=MATCH, policies=policies, seeds=[str(s) for s in seeds], budgets=[int(b) for b in budgets], success_policy=success_policy, baselines=baselines, min_win_rate=rate, min_delta=delta)
    checks = {"runs_present": gates.empty(rows)} | _kept(checks, set(required))
    if {"same_count", "plan"} & set(required):
        planned = read_plan(spark, plan_path or f"{roots[0].rstrip('/')}/same_count_configs/{PLAN_FILE}") if "plan" in required else None
        lost = [spark.range(1)] if "plan" in required and planned is None else []
        is_control = F.coalesce(F.col("control") == CONTROL, F.lit(False))
        absent = [gates.empty(rows.where(is_control))]
        checks["same_count_controls_present"] = gate_sets.any_of(same_count_problems(t, source_policy or success_policy or "", planned, control_policy), *lost, *absent)
        if success_policy:
            one = rows.where(~is_control & (F.col("policy") == success_policy)).unionByName(rows.where(is_control).withColumn("policy", F.lit(CONTROL)))
            value = {"auc": "auc", "heldout": "heldout_metric", "final": "final"}
            checks |= {f"success_policy_beats_same_count_{m}": cmp.success_check(one, MATCH, value[m], success_policy, [CONTROL], r, delta.get(m, 0.0)).where("not passed") for m, r in rate.items()}
    return gates.report({k: c for k, c in checks.items() if not only or k in only})


def fixed_scorer_gate(spark: SparkSession, *roots: str, controls, seeds=(), budgets=(), metric: str | None = None, mode: str = "auto", required: set[str] = frozenset({"heldout", "paper_mode", "provider_usage"})) -> DataFrame:
    t = gathered(spark, *roots, metric=metric, mode=mode, seed_usage="provider_usage" in required)
    rows = _text_runs(t)
    checks = gate_sets.fixed_scorer_gate(rows, t.attempts, t.certificates, controls=list(controls), seeds=[str(s) for s in seeds], budgets=[int(b) for b in budgets])
    return gates.report({"runs_present": gates.empty(rows)} | _kept(checks, set(required)))


def plan_same_count(spark: SparkSession, *roots: str, output: str, source_policy: str, control_policies: list[str], metric: str | None = None, mode: str = "auto", base_output_dir: str | None = None) -> list[dict]:
    """Write a configuration for the control of each source run, and the plan; the best of the control policies at the source's keys is run. A source without a synthetic count raises."""
    import yaml

    from cinderloom.operators.config import value_name

    t = gathered(spark, *roots, metric=metric, mode=mode)
    rows = _text_runs(t)
    named = rows.select("run_id", F.col("final").alias("_f"), "run", "action_space")
    direction = (rows.select("mode").where("mode <> ''").first() or ["max"])[0]
    sources = same_count.plan(rows, MATCH, source_policy, control_policies, "final", direction).join(named.withColumnRenamed("run_id", "source_run"), "source_run").join(t.configs.withColumnRenamed("run_id", "source_run"), "source_run")
    out, place = [], Path(output)
    place.mkdir(parents=True, exist_ok=True)
    # One row a control run that somebody has to start.
    for r in sources.orderBy(*MATCH).collect():
        if r["synthetic_record_budget"] is None:
            raise ValueError(f"source run has no synthetic count: {r['run']}")
        policy = r["control_policy"] or control_policies[0]
        config = json.loads(r["config"])
        name = f"{config.get('name', 'experiment')}_{CONTROL}_{value_name(policy)}_s{value_name(r['seed'])}_b{value_name(r['budget'])}"
        config |= {"name": name, "policy_name": policy, "control_name": CONTROL, "synthetic_record_budget": r["synthetic_record_budget"], "token_budget": r["budget"]}
        config |= {"base_output_dir": base_output_dir} if base_output_dir else {}
        path = place / f"{name}.yaml"
        path.write_text(yaml.safe_dump(config, sort_keys=False), encoding="utf-8")
        out.append({
            "config_path": str(path), "control_experiment_name": name, "control_policy_name": policy, "source_run_id": r["run"], "source_run_dir": r["source_run"], "source_policy_name": source_policy, "source_action_space_id": r["action_space"],
            "source_final_metric": r["_f"], "synthetic_record_budget": r["synthetic_record_budget"], "match_key": {PLAN_NAMES.get(k, k): "" if r[k] is None else str(r[k]) for k in MATCH},
        })
    (place / PLAN_FILE).write_text(json.dumps(out, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return out
