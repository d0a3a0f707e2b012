"""One row per run from its artifacts: metric path, token totals and quality-cost areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderloom.operators.quality_cost import PREFERRED_METRICS, best_first_final, quality_cost_auc, resolved_mode
from cinderloom.sources import artifacts


class NotCompleted(ValueError):
    """A run's status is not completed; the summary stops rather than leave it out."""


def eval_points(found: DataFrame, metric: str) -> DataFrame:
    """dir, cycle, y (the metric) and x (tokens spent when it was measured: the metric row's own count, else the ledger's running total)."""
    rows = artifacts.cycle_metrics(found).groupBy("dir", "cycle").agg(F.max(F.when(F.col("metric") == metric, F.col("value"))).alias("y"), F.max(F.when(F.col("metric") == "_teacher_tokens_at_eval", F.col("value"))).alias("own"))
    w = Window.partitionBy("dir").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    ledger = artifacts.token_cycles(found).groupBy("dir", "cycle").agg(F.sum("tokens").alias("tokens")).withColumn("spent", F.sum("tokens").over(w)).select("dir", "cycle", "spent")
    return rows.join(ledger, ["dir", "cycle"], "left").select("dir", "cycle", "y", F.coalesce("own", "spent", F.lit(0)).cast("double").alias("x"))


def summarize(spark: SparkSession, *roots: str, metric: str | None = None, mode: str = "auto", strict: bool = True) -> DataFrame:
    """The summary of every run below the roots. strict: a run that did not complete raises; else it is left out."""
    every = artifacts.files(spark, *roots)
    # Not cached: a cached scan would answer for the same roots after new runs have appeared.
    found = every.join(artifacts.run_dirs(every), "dir")
    context = artifacts.contexts(found)
    bad = context.where(F.coalesce(F.col("status") != "completed", F.lit(True)))
    if strict and not bad.isEmpty():
        raise NotCompleted(", ".join(r[0] for r in bad.select("dir").limit(5).collect()))
    context = context.join(bad.select("dir"), "dir", "left_anti")
    if metric is None:
        names = {r[0] for r in artifacts.cycle_metrics(found).where(F.col("metric").isin(list(PREFERRED_METRICS))).select("metric").distinct().collect()}
        metric = next((m for m in PREFERRED_METRICS if m in names), None)
        if metric is None:
            raise ValueError("no known metric in any cycle")
    mode = resolved_mode(metric, mode)
    p = eval_points(found, metric).join(context.select("dir", "token_budget"), "dir").join(artifacts.grand_total(found), "dir", "left")
    online = p.withColumn("online", F.greatest(F.lit(0.0), F.col("x") - F.col("seed_tokens")))
    h = F.col("token_budget")
    total = quality_cost_auc(p, ["dir"], "x", "y", h + F.col("seed_tokens"), "total_teacher_quality_cost_auc")
    cycle = quality_cost_auc(p, ["dir"], "x", "y", h, "cycle_quality_cost_auc")
    acquired = quality_cost_auc(online, ["dir"], "online", "y", h, "online_acquisition_quality_cost_auc")
    path = best_first_final(p, "y", mode, run="dir").select("dir", F.col("first_metric").alias("seed_baseline_metric"), "best_cycle", "best_metric", "final_cycle", F.col("final_metric").alias("final_metric"))
    held = artifacts.heldout(found).select("dir", artifacts.text(F.col("heldout"), metric).try_cast("double").alias("heldout_metric"), artifacts.text(F.col("heldout"), "_selection_split").alias("heldout_split"))
    out = context.withColumn("metric", F.lit(metric)).withColumn("mode", F.lit(mode))
    for part in (path, total, cycle, acquired, held, artifacts.grand_total(found)):
        out = out.join(part, "dir", "left")
    return out.withColumn("online_tokens", F.greatest(F.lit(0), F.col("grand_tokens") - F.col("seed_tokens")))
