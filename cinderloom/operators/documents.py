"""Nested JSON documents as rows of paths and values: flattening by VARIANT, fingerprints and differences.

Documents are parsed once to VARIANT and opened a level at a time by ``variant_explode``, so what a
level costs follows its rows, and the number of levels is the documents' depth. Nothing is
inferred from a sample and no document reaches Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.sources.staging import staged


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def flattened(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, path, kind, value: a row for each value of a document that holds no others, an empty object or list among them.

    Paths are like ``$.a.b[0]``; values are JSON texts. A document that can't be read, or is null, gives no row;
    equal rows are documents each. Keys of any type, null too.
    """
    level = rows.select(*keys, F.try_parse_json(F.col(text)).alias("_v"), F.lit("$").alias("path")).where("_v is not null").withColumn("kind", _kind(F.col("_v")))
    out = []
    while True:
        level = staged(level)
        full = F.col("kind").isin("object", "array") & ~F.to_json("_v").isin("{}", "[]")
        out.append(level.where(~full).select(*keys, "path", "kind", F.to_json("_v").alias("value")))
        inner = level.where(full)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, out)
        parts = inner.select(*keys, F.col("path").alias("_p"), "_v").lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = parts.select(*keys, F.col("value").alias("_v"), F.concat("_p", step).alias("path")).withColumn("kind", _kind(F.col("_v")))


def under(path: Column, names: Sequence[str]) -> Column:
    """Whether a path lies below one of the document's own keys."""
    return F.regexp_extract(path, r"^\$\.([^.\[]+)", 1).isin(list(names))


def fingerprints(flat: DataFrame, keys: Sequence[str], volatile: Sequence[str] = ()) -> DataFrame:
    """keys and sha256 of each document's paths and values in order, whatever its keys' order was; those below the volatile keys don't count."""
    some = flat.where(~under(F.col("path"), volatile)) if volatile else flat
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit("="), "value")))
    return some.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, path, left, right, problem (absent_left, absent_right, changed) of two flattened sets with one document a key."""
    l, r = left.select(*keys, "path", F.col("value").alias("left")), right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_path"), F.col("value").alias("right"))
    on = F.col("path") == F.col("_path")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = l.join(r, on, "full")
    problem = F.when(F.col("path").isNull(), "absent_left").when(F.col("_path").isNull(), "absent_right").when(F.col("left") != F.col("right"), "changed")
    there = F.col("path").isNotNull()
    return both.select(*[F.when(there, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], F.coalesce("path", "_path").alias("path"), "left", "right", problem.alias("problem")).where("problem is not null")
