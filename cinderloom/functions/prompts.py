"""Prompt text and replies: sample blocks, choices, taxonomies, structured output, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of a structured reply: records of prompt, response and gold answer, or articles of text and label.
REPLY = "struct<records:array<struct<student_prompt:string,teacher_response:string,gold_answer:string>>,articles:array<struct<text:string,label:int>>>"


def sample_block(samples: DataFrame, text: str = "text", label: str = "label", predicted: str | None = None, order: str = "idx") -> DataFrame:
    """One row, block: a numbered list of samples with label (and prediction). Samples are a top-k selection."""
    line = F.concat(F.lit(". "), F.col(text), F.lit("\n   label: "), F.coalesce(F.col(label).cast("string"), F.lit("")), *([F.lit("\n   predicted: "), F.coalesce(F.col(predicted).cast("string"), F.lit(""))] if predicted else []))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return samples.agg(F.array_join(F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), x["t"])), "\n").alias("block"))


def choices_block(labels: Column, texts: Column) -> Column:
    """Multiple-choice options, one a line."""
    return F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(") "), b)), "\n")


def taxonomy(names: Column) -> Column:
    """Class numbers with their names, one a line."""
    return F.array_join(F.transform(names, lambda n, i: F.concat(i.cast("string"), F.lit(": "), n)), "\n")


def classification_prompt(text: Column, names: Column, task: str = "") -> Column:
    head = f"{task}\n\n" if task else ""
    return F.concat(F.lit(f"{head}Classes:\n"), taxonomy(names), F.lit("\n\nText:\n"), text, F.lit('\n\nAnswer with JSON {"class_label": <number>}.'))


def parsed_records(reply: Column) -> Column:
    """Records of a structured reply; an empty list if it can't be read."""
    return F.coalesce(F.from_json(reply, REPLY, {"mode": "PERMISSIVE"})["records"], F.array().cast("array<struct<student_prompt:string,teacher_response:string,gold_answer:string>>"))


def usage(prompt: Column, completion: Column, total: Column, strict: bool = False) -> Column:
    """input, output and total tokens; a missing total is their sum, a smaller one raises if strict."""
    p, c = F.coalesce(prompt, F.lit(0)).cast("long"), F.coalesce(completion, F.lit(0)).cast("long")
    told = F.coalesce(total.cast("long"), p + c)
    if strict:
        told = F.when(told < p + c, F.raise_error("total tokens below their parts").cast("long")).otherwise(told)
    return F.struct(p.alias("input_tokens"), c.alias("output_tokens"), told.alias("total_tokens"))
