"""Supervised records: schema completion, union of synthetic rows, gold materialisation, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.functions.scalars import safety_margin, tokens_floor
from cinderloom.operators.ranks import ranked


def ensure_origin_columns(rows: DataFrame, split: str) -> DataFrame:
    """source_split, source_idx (source_index or -1) and origin_cycle (cycle or 0), where they lack."""
    c = rows.columns
    wanted = {
        "source_split": F.lit(split),
        "source_idx": F.col("source_index").cast("long") if "source_index" in c else F.lit(-1).cast("long"),
        "origin_cycle": F.col("cycle").cast("int") if "cycle" in c else F.lit(0),
    }
    for name, value in wanted.items():
        rows = rows if name in c else rows.withColumn(name, value)
    return rows


def default_for(kind: T.DataType) -> Column:
    """The value of a column that a row lacks."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def union_synthetic(train: DataFrame, synthetic: DataFrame) -> DataFrame:
    """train and the synthetic rows in its schema: further columns go, missing ones get their type's default."""
    some = [F.coalesce(F.col(f.name).cast(f.dataType), default_for(f.dataType)).alias(f.name) if f.name in synthetic.columns else default_for(f.dataType).alias(f.name) for f in train.schema]
    return train.unionByName(synthetic.select(*some))


def encoded_labels(rows: DataFrame, label: str) -> DataFrame:
    """rows with class_id: the place, from 0, of the label among all distinct ones in order; null for null. The dictionary is a table that is joined, of whatever size."""
    names = ranked(rows.select(F.col(label).alias("_label")).where("_label is not null").distinct(), [], ["_label"], "_place")
    return rows.join(names, F.col(label) == F.col("_label"), "left").withColumn("class_id", F.col("_place") - 1).drop("_label", "_place")


def prompt_response(prompt: Column, response: Column, before: str = "### Instruction:\n", between: str = "\n\n### Response:\n") -> Column:
    return F.concat(F.lit(before), prompt, F.lit(between), response)


def instruction_text(instruction: Column, context: Column, output: Column) -> Column:
    """Instruction, optional input and output as one training text."""
    given = F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(F.lit("\n"), context)).otherwise("")
    return prompt_response(F.concat(instruction, given), output)


def rendered(template: str, **values: Column) -> Column:
    """A template with {name} fields; a name without a value raises."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise KeyError(name)
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def preflight(input_tokens: Column, max_output: int, remaining: Column, strict: bool = True) -> tuple[Column, Column]:
    """Predicted tokens of a call and whether it may be sent (an unknown remainder lets it)."""
    bare = input_tokens + max_output
    predicted = bare + safety_margin(bare) if strict else bare
    return predicted, remaining.isNull() | (predicted <= remaining)


def gold_records(turns: DataFrame, run: str = "materialised") -> DataFrame:
    """Supervised records from conversations: each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w)).where("role = 'user' and next_role = 'assistant'")
    return pairs.select(
        F.concat_ws("/", F.lit(run), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("student_prompt"), F.col("response").alias("gold_answer"),
        prompt_response(F.col("text"), F.col("response")).alias("sft_text"), tokens_floor(F.length("text")).alias("prompt_tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("prompt_sha256"), F.lit("train").alias("source_split"), F.col("turn").alias("source_index"),
    )


def manifest(records: DataFrame, rejected: int = 0) -> DataFrame:
    """One row about a materialisation."""
    return records.agg(F.count("*").alias("records"), F.count_distinct("id").alias("distinct_ids"), F.sum("prompt_tokens").alias("prompt_tokens"), F.lit(rejected).alias("rejected"))


def agreement(records: DataFrame, teacher: str, gold: str) -> DataFrame:
    """Teacher answers that match the gold ones, and the share that does not."""
    same = F.col(teacher) == F.col(gold)
    return records.agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), F.count("*").alias("n")).withColumn("disagreement_rate", F.col("disagree") / F.greatest(F.lit(1), F.col("n")))
