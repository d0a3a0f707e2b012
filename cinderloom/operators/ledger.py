"""Teacher attempts and token ledgers: calibration, certificates, roll-ups, budget stops.

Attempts have run_id, attempt_id, ord (their place in the log), cycle, status, predicted,
ledger, provider, before and after (tokens), of which the numbers may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def token_rollup(usage: DataFrame, cycle: str = "cycle", operation: str = "operation", values: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """Sums by cycle and operation, by each of them, and in total; level tells which. A sum is null only if all its values are."""
    g = usage.groupingSets([[F.col(cycle), F.col(operation)], [F.col(cycle)], [F.col(operation)], []], cycle, operation)
    level = F.when(F.grouping(cycle) + F.grouping(operation) == 2, "total").when(F.grouping(operation) == 1, "cycle").when(F.grouping(cycle) == 1, "operation").otherwise("cycle_operation")
    return g.agg(level.alias("level"), *[F.sum(v).alias(v) for v in values])


def status_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts by status and in all; a budget violation is a failure as well as a status of its own."""
    status = F.col("status")
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(status == "success").alias("successes"), F.count_if(status == "masked").alias("masked"),
        F.count_if(status == "budget_violation").alias("budget_violations"), F.count_if(~status.isin("success", "masked")).alias("failures"),
        F.max(F.try_divide("ledger", "predicted")).alias("max_realized_ratio"),
    )


def calibration(attempts: DataFrame) -> DataFrame:
    """One row per attempt: ratio of realised to predicted tokens and whether it went over (null where unknown)."""
    realised = F.coalesce("provider", "ledger")
    return attempts.withColumn("calibration_ratio", F.try_divide(realised, F.col("predicted"))).withColumn("over_preflight", F.col("ledger") > F.col("predicted") + EPSILON).withColumn("over_remaining", F.col("ledger") > F.col("before") + EPSILON)


def failure_class(error: Column, failure_type: Column, status: Column, parsed: Column, accepted: Column) -> Column:
    """invalid_label, parse_failure or null."""
    text = F.lower(F.coalesce(error, F.lit("")))
    bad_label = text.contains("non-canonical") | text.contains("mismatched labels")
    kinds = F.lower(F.coalesce(failure_type, F.lit(""))).isin("invalid_json", "no_records_parsed", "no_records_accepted")
    nothing = F.coalesce((parsed == 0) & F.coalesce(accepted == 0, F.lit(True)), F.lit(False))
    return F.when(bad_label, "invalid_label").when(kinds | (F.lower(status) == "empty_response") | nothing, "parse_failure")


def budget_certificate(attempts: DataFrame, budgets: DataFrame, key: str = "run_id", budget: str = "budget") -> DataFrame:
    """One row per run: violations with their attempts in log order, totals, the five conditions and whether all hold."""
    ledger = F.coalesce("ledger", F.lit(0.0))
    before, after, predicted, provider = F.col("before"), F.col("after"), F.col("predicted"), F.col("provider")
    violations = {
        "over_preflight": ledger > predicted + EPSILON,
        "over_remaining": ledger > before + EPSILON,
        "provider_over_ledger": provider > ledger + EPSILON,
        "missing_preflight": predicted.isNull() & (ledger > EPSILON),
        "missing_ledger": F.col("ledger").isNull() & (F.col("status") != "masked"),
        "remaining_mismatch": F.abs(after - (before - ledger)) > EPSILON,
        "negative_remaining": before.isNotNull() & (after < -EPSILON),
    }
    ids = {k: F.transform(F.array_sort(F.collect_list(F.when(v, F.struct("ord", "attempt_id")))), lambda x: x["attempt_id"].cast("string")) for k, v in violations.items()}
    runs = attempts.groupBy(key).agg(
        F.count("*").alias("attempt_rows"), F.count_if(F.col("status") == "masked").alias("masked_rows"), F.sum(ledger).alias("ledger_total"),
        F.coalesce(F.sum("provider"), F.lit(0.0)).alias("provider_total"), *[i.alias(f"{k}_ids") for k, i in ids.items()],
    )
    rows = runs.join(budgets.select(key, budget), key, "left")
    none = {k: F.size(f"{k}_ids") == 0 for k in violations}
    within = F.when(F.col(budget).isNotNull(), F.col("ledger_total") <= F.col(budget) + EPSILON).otherwise(F.col("ledger_total") <= EPSILON)
    reasons = F.array(
        F.when(~within, F.when(F.col(budget).isNull(), "missing_token_budget").otherwise("ledger_exceeds_token_budget")),
        *[F.when(~none[k], r) for k, r in (
            ("over_preflight", "ledger_exceeds_preflight"), ("over_remaining", "ledger_exceeds_remaining_budget"), ("provider_over_ledger", "provider_exceeds_ledger"), ("missing_preflight", "missing_preflight_bound"),
            ("missing_ledger", "missing_ledger_debit"), ("remaining_mismatch", "remaining_budget_mismatch"), ("negative_remaining", "negative_remaining_budget"))],
    )
    out = rows.select(
        key, budget, "attempt_rows", (F.col("attempt_rows") - F.col("masked_rows")).alias("dispatched_rows"), "masked_rows", "ledger_total", "provider_total",
        *[F.size(f"{k}_ids").alias(f"{k}_rows") for k in violations], within.alias("ledger_within_budget"), (none["over_preflight"] & none["missing_preflight"]).alias("preflight_bounds_ledger"),
        none["provider_over_ledger"].alias("provider_bounded_by_ledger"), (none["over_remaining"] & none["remaining_mismatch"] & none["negative_remaining"]).alias("remaining_consistent"),
        F.array_join(F.array_sort(F.array_compact(reasons)), ",").alias("failure_reasons"), *[F.array_join(f"{k}_ids", ",").alias(f"{k}_ids") for k in violations], none["missing_ledger"].alias("_ledger"),
    )
    passed = F.col("ledger_within_budget") & F.col("preflight_bounds_ledger") & F.col("provider_bounded_by_ledger") & F.col("_ledger") & F.col("remaining_consistent")
    return out.withColumn("certificate_passed", passed).drop("_ledger")


def budget_audit(runs: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Group totals of runs and their attempts; attempts are summed per run first, so a run counts once."""
    per_run = attempts.groupBy("run_id").agg(
        F.count("*").alias("attempts"), F.sum("ledger").alias("ledger"), F.sum("predicted").alias("predicted"), F.count_if(F.col("ledger") > F.col("predicted") + EPSILON).alias("over"), F.count_if(F.col("status") == "masked").alias("masked")
    )
    rows = runs.join(per_run, "run_id", "left")
    spent = F.coalesce("ledger", F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.count("attempts").alias("runs_with_attempts"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.sum(spent).alias("ledger_total"), F.sum("predicted").alias("predicted_total"),
        F.sum(F.greatest(F.col("budget") - spent, F.lit(0.0))).alias("unused_budget"), F.count_if(spent > F.col("budget") + EPSILON).alias("runs_over_budget"), F.coalesce(F.sum("over"), F.lit(0)).alias("attempts_over_preflight"),
        F.coalesce(F.sum("masked"), F.lit(0)).alias("masked_attempts"), F.try_divide(F.sum("ledger"), F.sum("predicted")).alias("reserve_ratio"),
    )


def budget_stop(attempts: DataFrame, budget: Column, run: str = "run_id") -> DataFrame:
    """First attempt of each run at which the running ledger reaches the budget (null if it never does). A total that equals the budget but for the rounding of its additions reaches it."""
    w = Window.partitionBy(run).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    spent = attempts.withColumn("spent", F.sum(F.coalesce("ledger", F.lit(0.0))).over(w))
    return spent.groupBy(run).agg(F.min(F.when(F.col("spent") >= budget - EPSILON, F.col("ord"))).alias("stop_at"), F.max("spent").alias("spent"))


def prefix_within_budget(rows: DataFrame, run: str, order: str, cost: str, budget: Column) -> DataFrame:
    """Rows accepted in order while the total stays within the budget; the first that does not fit ends it, no later row is tried."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total_cost", F.sum(cost).over(w)).withColumn("_bad", F.max((F.col("total_cost") > budget).cast("int")).over(w)).where("_bad = 0").drop("_bad")


def orphans(attempts: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Attempts whose run is unknown or null."""
    return attempts.join(runs.select(key).distinct(), key, "left_anti")


def frequencies(rows: DataFrame, parent: list[str], action: str) -> DataFrame:
    """Count of each action and its share of the parent group."""
    counts = rows.groupBy(*parent, action).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*parent)))


def seed_online_split(usage: DataFrame, key: str, operation: str = "operation", tokens: str = "tokens", seed_operation: str = "sft_data") -> DataFrame:
    """Tokens charged to seed data, and the rest (not below 0)."""
    seed, total = F.sum(F.when(F.col(operation) == seed_operation, F.col(tokens)).otherwise(0)), F.sum(tokens)
    return usage.groupBy(key).agg(seed.alias("seed_tokens"), total.alias("total_tokens")).withColumn("online_tokens", F.greatest(F.lit(0), F.col("total_tokens") - F.col("seed_tokens")))


def rank_and_margin(scores: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """Place of each action by score (ties by name) and its lead over the best other one."""
    w, every = Window.partitionBy(key).orderBy(F.desc(score), name), Window.partitionBy(key)
    rows = scores.withColumn("score_rank", F.row_number().over(w))
    first, second = F.max(F.when(F.col("score_rank") == 1, F.col(score))).over(every), F.max(F.when(F.col("score_rank") == 2, F.col(score))).over(every)
    return rows.withColumn("score_margin", F.col(score) - F.when(F.col("score_rank") == 1, second).otherwise(first))
