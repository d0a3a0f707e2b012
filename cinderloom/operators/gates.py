"""Validation gates: each check is a DataFrame of violations; a gate passes if none has a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """name, passed and the number of violations of each check, in one plan."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), (F.col("violations") == 0).alias("passed"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def overall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ",").alias("failed"))


def missing_values(rows: DataFrame, column: str, expected: list) -> DataFrame:
    """Expected values that no row has."""
    spark = rows.sparkSession
    kind = rows.schema[column].dataType.simpleString()
    return spark.createDataFrame([(x,) for x in expected], f"`{column}` {kind}").join(rows.select(column).distinct(), column, "left_anti")


def unreported(attempts: DataFrame) -> DataFrame:
    """Dispatched attempts without usage from the provider."""
    return attempts.where((F.col("status") != "masked") & F.col("provider").isNull())


def empty(rows: DataFrame) -> DataFrame:
    """One violation if there are no rows."""
    return rows.agg(F.count("*").alias("n")).where("n = 0")


def not_completed(runs: DataFrame) -> DataFrame:
    return runs.where(F.coalesce(F.col("status") != "completed", F.lit(True)))


def not_paper_mode(runs: DataFrame) -> DataFrame:
    return runs.where(~F.coalesce(F.col("paper_mode"), F.lit(False)))


def cycles_out_of_bounds(runs: DataFrame) -> DataFrame:
    done, expected = F.col("cycles_completed"), F.col("expected_cycles")
    return runs.where(~F.coalesce((done > 0) & (done <= expected), F.lit(False)))


def estimated_usage(rows: DataFrame, column: str = "estimated_rows") -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit(0)) > 0)


def heldout_missing(runs: DataFrame) -> DataFrame:
    return runs.where(~F.coalesce((F.col("heldout_split") == "test") & F.col("heldout_metric").isNotNull(), F.lit(False)))


def over_budget(runs: DataFrame, spent: str = "ledger_total", budget: str = "budget") -> DataFrame:
    return runs.where(F.col(spent) > F.col(budget) + EPSILON)


def failed_certificates(certificates: DataFrame) -> DataFrame:
    return certificates.where("not certificate_passed")


def inconsistent(rows: DataFrame, column: str) -> DataFrame:
    """One violation if non-blank values differ between rows."""
    return rows.agg(F.count_distinct(F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))).alias("n")).where("n > 1")


def seed_baselines_differ(deltas: DataFrame, column: str = "delta_seed") -> DataFrame:
    return deltas.where(F.abs(column) > EPSILON)


def unavailable_frontier(rows: DataFrame) -> DataFrame:
    return rows.where("not frontier_available")


def failing_comparisons(checks: DataFrame) -> DataFrame:
    return checks.where("not passed")


def wrong_operators(decisions: DataFrame, policy: str, expected: str) -> DataFrame:
    """Decisions of a fixed policy whose operator is another."""
    return decisions.where((F.col("policy_name") == policy) & ~F.col("is_stop") & (F.col("operator") != expected))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")
