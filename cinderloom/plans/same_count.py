"""Same-count controls: the plan of control runs that match source runs, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.operators import documents
from cinderloom.operators.comparison import matched_control, null_safe


def plan(runs: DataFrame, keys: list[str], source_policy: str, control_policies: list[str], value: str = "final", mode: str = "max") -> DataFrame:
    """A row for each source run: the policy that its control runs, and the synthetic records it may use."""
    source = runs.where((F.col("policy") == source_policy) & (F.coalesce("control", F.lit("")) == ""))
    best = matched_control(keys, runs, value, control_policies, mode).select(*keys, F.col("policy").alias("control_policy"))
    rows = null_safe(source, best, keys, "left")
    name = F.concat(F.lit("same_count_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256), 1, 12))
    return rows.select(*keys, F.col("run_id").alias("source_run"), "control_policy", F.col("synthetic_count").alias("synthetic_record_budget"), name.alias("control_name"))


def reconcile(planned: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """Plan against control runs by text keys (null and empty alike): missing, unplanned, repeated and differing counts."""
    named = lambda df: df.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key"), *[c for c in df.columns if c not in keys])
    p = named(planned).groupBy("key").agg(F.count("*").alias("planned"), F.max("synthetic_record_budget").alias("planned_count"))
    c = named(controls).groupBy("key").agg(F.count("*").alias("found"), F.max("synthetic_count").alias("found_count"))
    problem = (
        F.when(F.col("found").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when(F.col("planned") > 1, "duplicate_plan").when(F.col("found") > 1, "duplicate_control").when(~F.col("planned_count").eqNullSafe(F.col("found_count")), "count_mismatch")
    )
    return p.join(c, "key", "full").withColumn("problem", problem)


def reconcile_runs(planned: DataFrame, controls: DataFrame, sources: DataFrame, keys: list[str], volatile: list[str] = ()) -> DataFrame:
    """Plan, control runs and source runs against each other: keys, run_id, problem, expected, found; a row for each problem.

    planned: keys, control_name, control_policy, synthetic_record_budget. controls and sources: keys,
    run_id, experiment, policy, action_space, synthetic_count, config (JSON text); a source's key is
    its own. Controls have to be planned, once a key, under a planned name and policy, with the
    source's count, action space and configuration, of which the volatile keys may differ.
    ``documents.differences`` names the paths in which two configurations differ.
    """
    prints = lambda df: documents.fingerprints(documents.flattened(df.select("run_id", "config"), ["run_id"], "config"), ["run_id"], volatile)
    named = lambda df, ks, prefix: df.select(*ks, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in ks])
    same = prints(controls.unionByName(sources))
    signed = lambda df: df.join(same, "run_id", "left")
    p = planned.groupBy(*keys).agg(F.collect_set("control_name").alias("names"), F.collect_set("control_policy").alias("policies"))
    s = named(signed(sources), keys, "s")
    rows = null_safe(null_safe(signed(controls), named(p.withColumn("there", F.lit(True)), keys, "p"), keys, "left"), s, keys, "left")
    known = F.col("s_run_id").isNotNull()
    blank = F.coalesce("action_space", F.lit("")) == ""
    checks = {
        "unplanned": (F.col("p_there").isNull(), F.lit(None).cast("string"), F.col("experiment")),
        "name_mismatch": ((F.size("p_names") > 0) & ~F.array_contains("p_names", F.col("experiment")), F.array_join(F.array_sort("p_names"), ","), F.col("experiment")),
        "policy_mismatch": ((F.size("p_policies") > 0) & ~F.array_contains("p_policies", F.col("policy")), F.array_join(F.array_sort("p_policies"), ","), F.col("policy")),
        "count_mismatch": (known & ~F.col("synthetic_count").eqNullSafe(F.col("s_synthetic_count")), F.col("s_synthetic_count").cast("string"), F.col("synthetic_count").cast("string")),
        "action_space_mismatch": (known & (blank | ~F.col("action_space").eqNullSafe(F.col("s_action_space"))), F.col("s_action_space"), F.col("action_space")),
        "config_mismatch": (known & ~F.col("sha256").eqNullSafe(F.col("s_sha256")), F.col("s_sha256"), F.col("sha256")),
    }
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("problem"), want.alias("expected"), got.alias("found"))) for name, (bad, want, got) in checks.items()])
    each = rows.select(*keys, "run_id", F.explode(F.array_compact(found)).alias("x")).select(*keys, "run_id", "x.*")
    count = lambda df, problem, more: df.groupBy(*keys).agg(F.min("run_id").alias("run_id"), F.count("*").alias("n")).where("n > 1").select(*keys, "run_id", F.lit(problem).alias("problem"), F.lit(more).alias("expected"), F.col("n").cast("string").alias("found"))
    present = null_safe(p, controls.select(*keys).distinct().withColumn("_c", F.lit(True)), keys, "left").where("_c is null")
    kind = controls.schema["run_id"].dataType
    missing = present.select(*keys, F.lit(None).cast(kind).alias("run_id"), F.lit("missing").alias("problem"), F.array_join(F.array_sort("names"), ",").alias("expected"), F.lit(None).cast("string").alias("found"))
    return each.unionByName(count(controls, "duplicate_control", "1")).unionByName(count(sources, "duplicate_source", "1")).unionByName(missing)
