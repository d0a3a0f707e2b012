"""Field choice and row validity: what a dataset, a ledger or a run must have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.functions.scalars import canonical_label

# Fields that may hold the text and the label, in order of preference.
TEXT_FIELDS = ("student_prompt", "text", "sentence", "query")
LABEL_FIELDS = ("gold_answer", "label", "teacher_response")


def text_field(rows: DataFrame, configured: list[str] = []) -> str | None:
    return next((c for c in (*configured, *TEXT_FIELDS) if c in rows.columns), None)


def label_field(rows: DataFrame, configured: list[str] = []) -> str | None:
    return next((c for c in (*configured, *LABEL_FIELDS) if c in rows.columns), None)


def is_control(control: Column, policy: Column, names: list[str]) -> Column:
    """A same-count control by its control name or its policy."""
    return F.coalesce(control.isin(names), F.lit(False)) | F.coalesce(policy.isin(names), F.lit(False))


def is_fixed(policy: Column, control: Column, names: list[str]) -> Column:
    return F.coalesce(policy.startswith("fixed_"), F.lit(False)) & ~is_control(control, policy, names)


def valid_labels(rows: DataFrame, response: str, canonical: list[str], gold: str | None = None) -> DataFrame:
    """Rows whose normalised response is a canonical label (and the gold one, if named)."""
    told = canonical_label(F.col(response))
    ok = told.isin(canonical)
    return rows.where(ok & (told == canonical_label(F.col(gold))) if gold else ok)


def require_splits(rows: DataFrame, needed: tuple[str, ...] = ("train", "validation", "test")) -> None:
    missing = set(needed) - {r[0] for r in rows.select("split").distinct().collect()}
    if missing:
        raise ValueError(f"missing splits: {sorted(missing)}")


def evaluation_split(available: list[str]) -> str:
    """The split that selection uses: validation, else test, else train."""
    return next(s for s in ("validation", "test", "train") if s in available)


def heldout_split(available: list[str]) -> str | None:
    """test, unless selection uses it."""
    return "test" if "test" in available and evaluation_split(available) != "test" else None


def has_keys(document: Column, *keys: str) -> Column:
    """Whether a map has every key."""
    return F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(document, k))


def bad_usage(rows: DataFrame, inputs: str, outputs: str, total: str, estimated: str | None = None) -> DataFrame:
    """Rows whose total is missing or below its parts; estimated ones too where they are barred."""
    short = F.col(total).isNull() | (F.col(total) < F.coalesce(inputs, F.lit(0)) + F.coalesce(outputs, F.lit(0)))
    return rows.where(short | F.coalesce(F.col(estimated), F.lit(False)) if estimated else short)


def augmented_rows(records: DataFrame, cycle: int, teacher: str, operator: str) -> DataFrame:
    """Training rows of a teacher's records; those without prompt or response are left out, gold defaults to the response."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    some = records.where(~blank("student_prompt") & ~blank("teacher_response"))
    gold = F.coalesce("gold_answer", "teacher_response") if "gold_answer" in records.columns else F.col("teacher_response")
    return some.select("student_prompt", "teacher_response", gold.alias("gold_answer"), F.lit("augmented").alias("source_split"), F.lit(-1).cast("long").alias("source_idx"), F.lit(cycle).alias("origin_cycle"), F.lit(teacher).alias("teacher_model"), F.lit(operator).alias("prompt_operator"))


def named_failures(checks: dict[str, Column]) -> Column:
    """The names of the conditions that do not hold, sorted and joined by semicolons."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))), ";")


def threshold_failures(summary: DataFrame, least: dict[str, float]) -> DataFrame:
    """Summary rows of all budgets below a threshold, with the names of those they miss."""
    rows = summary.where("budget = 'ALL'").withColumn("failures", named_failures({f"{c}_below_threshold": F.col(c) >= v for c, v in least.items()}))
    return rows.where("failures <> ''")


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of several roots, repeated ones included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
