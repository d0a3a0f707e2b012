"""Report tables of a tree of runs, written together: one scan of the artifacts, one CSV for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.operators import comparison, ledger, run_summary
from cinderloom.sources import artifacts
from cinderloom.sources.sinks import write_csv

KEYS = ["dataset", "dataset_subset", "student_model", "student_type", "metric", "mode", "seed", "token_budget"]


def policy_behavior(found: DataFrame) -> DataFrame:
    """One row per decision: its action, the action's place among the scores and its lead."""
    d = artifacts.log(found, "policy_decisions.jsonl", artifacts.DECISION)
    scores = d.select("dir", "decision_id", "action_name", F.explode("action_scores").alias("name", "score"))
    place = F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("name") < F.col("action_name")))) + 1
    own = scores.where("name = action_name").select("dir", "decision_id", F.col("score").alias("own"))
    ranks = scores.join(own, ["dir", "decision_id"]).groupBy("dir", "decision_id").agg(place.alias("score_rank"), (F.max("own") - F.max(F.when(F.col("name") != F.col("action_name"), F.col("score")))).alias("score_margin"))
    flat = d.select("dir", "ord", "decision_id", "cycle", "policy_name", "action_name", F.col("action.prompt_operator").alias("prompt_operator"), F.col("action.teacher_tier").alias("teacher_tier"), F.col("action.batch_size").alias("batch_size"), F.coalesce("action.is_stop", F.lit(False)).alias("is_stop"), F.array_join("metadata.feasible_actions", ",").alias("feasible_actions"), F.col("metadata.acquisition_outcome").alias("acquisition_outcome"), F.col("metadata.records_added").alias("records_added"))
    return flat.join(ranks, ["dir", "decision_id"], "left")


def quality_cost_points(found: DataFrame, metric: str) -> DataFrame:
    """One row per run and cycle, and one for the held-out metric at the run's total tokens."""
    p = run_summary.eval_points(found, metric).join(artifacts.grand_total(found), "dir", "left")
    cycles = p.select("dir", "cycle", F.lit("selection").alias("split"), F.col("y").alias("value"), F.col("x").alias("total_tokens"), F.greatest(F.lit(0.0), F.col("x") - F.col("seed_tokens")).alias("online_tokens"))
    last = p.groupBy("dir").agg(F.max("cycle").alias("cycle"), F.max("grand_tokens").cast("double").alias("total_tokens"), F.max("seed_tokens").alias("seed"))
    held = artifacts.heldout(found).select("dir", artifacts.text(F.col("heldout"), metric).try_cast("double").alias("value")).where("value is not null")
    tests = held.join(last, "dir").select("dir", "cycle", F.lit("heldout").alias("split"), "value", "total_tokens", F.greatest(F.lit(0.0), F.col("total_tokens") - F.col("seed")).alias("online_tokens"))
    return cycles.unionByName(tests)


def tables(spark: SparkSession, *roots: str, success_policy: str, baselines: list[str], metric: str | None = None) -> dict[str, DataFrame]:
    """All report tables by name."""
    runs = run_summary.summarize(spark, *roots, metric=metric)
    every = artifacts.files(spark, *roots)
    found = every.join(artifacts.run_dirs(every), "dir")
    named = runs.withColumnsRenamed({"policy_name": "policy", "control_name": "control", "final_metric": "final"}).withColumn("run_id", F.col("dir"))
    name = metric or runs.select("metric").first()[0]
    mode = run_summary.resolved_mode(name)
    deltas = comparison.pairwise_deltas(named, KEYS, "final", success_policy, baselines, mode=mode)
    tries = artifacts.attempts(found)
    budgets = runs.select(F.col("dir").alias("run_id"), F.col("token_budget").alias("budget"))
    audit = named.select("run_id", "policy", "token_budget").withColumnRenamed("token_budget", "budget")
    behavior = policy_behavior(found)
    fixed = F.col("policy").startswith("fixed_") & (F.coalesce("control", F.lit("")) == "")
    return {
        "summary": runs,
        "main_results": comparison.main_results(named, [k for k in KEYS if k != "seed"] + ["policy", "control"], ["final", "heldout_metric", "total_teacher_quality_cost_auc"]),
        "pairwise_deltas": deltas,
        "pairwise_summary": comparison.pairwise_summary(deltas, [k for k in KEYS if k not in ("seed", "token_budget")] + ["baseline_policy"], "token_budget"),
        "oracle_frontier": comparison.oracle_frontier(named, KEYS, "final", fixed, mode),
        "policy_behavior": behavior,
        "action_frequencies": ledger.frequencies(behavior, ["dir"], "action_name"),
        "teacher_calibration": ledger.calibration(tries).drop("metadata"),
        "budget_feasibility": ledger.budget_certificate(tries, budgets),
        "budget_audit": ledger.budget_audit(audit, tries, ["policy", "budget"]),
        "quality_cost_points": quality_cost_points(found, name),
    }


def write(spark: SparkSession, output: str, *roots: str, **options) -> list[str]:
    """Every table as CSV below output; the names written."""
    made = tables(spark, *roots, **options)
    for name, df in made.items():
        flat = df.select(*[F.col(f.name) if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(f.name).alias(f.name) for f in df.schema])
        write_csv(flat, f"{output.rstrip('/')}/{name}", flat.columns)
    return sorted(made)
