"""Sample contexts of prompts as a table function: ``sample_context(TABLE(t) PARTITION BY run ORDER BY ...)``.

A context is a set of named, ordered collections of rows of one run. The function takes candidate rows
(run, kind, place, idx, payload) and gives run, collection, place, idx and payload. Candidates are
reduced in the JVM first, to a few rows a run and collection, so a run's partition is small however
many predictions it has. A subclass that overrides ``collections`` gives other collections;
registered under a name it is callable from SQL.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

OUTPUT = "run bigint, collection string, place int, idx bigint, payload string"
CANDIDATE = "run bigint, kind string, place int, idx bigint, payload string"


class SampleContext:
    """Collections of a run's candidates: one for each kind, in order of place."""

    def __init__(self):
        self.run, self.rows = None, []

    def eval(self, row: Row) -> None:
        self.run = row["run"]
        self.rows.append({"kind": row["kind"], "place": row["place"], "idx": row["idx"], **json.loads(row["payload"] or "{}")})

    def collections(self, run: int, rows: list[dict]) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["kind"], r["place"])):
            out.setdefault(r["kind"], []).append(r)
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            for name, rows in self.collections(self.run, self.rows).items():
                for k, r in enumerate(rows, 1):
                    yield self.run, name, k, r["idx"], json.dumps({a: b for a, b in r.items() if a not in ("kind", "place", "idx")}, sort_keys=True)


def register(spark: SparkSession, name: str = "sample_context", cls: type[SampleContext] = SampleContext) -> None:
    """Make a context class callable from SQL."""
    spark.udtf.register(name, udtf(cls, returnType=OUTPUT))


def candidates(predictions: DataFrame, run: str = "run", per_class: int = 2, top: int = 5, payload: list[str] | None = None) -> DataFrame:
    """The few rows of each run that a context may hold: first rows a class, most uncertain ones, most confident mistakes.

    predictions: run, idx, pred, true, conf, entropy. Ties go to the smaller idx. Spark's group
    limits leave as many rows a run and task as a collection has.
    """
    said = F.to_json(F.struct(*[F.col(c) for c in (payload or ["pred", "true"])]))

    def best(rows: DataFrame, kind: str, keys: list[str], n: int, *order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        some = rows.withColumn("_n", place).where(F.col("_n") <= n)
        # Classes in order, then their rows: one number that sorts both.
        at = F.row_number().over(Window.partitionBy(run).orderBy("true", "_n")) if keys != [run] else F.col("_n")
        return some.select(F.col(run).cast("bigint").alias("run"), F.lit(kind).alias("kind"), at.cast("int").alias("place"), F.col("idx").cast("bigint").alias("idx"), said.alias("payload"))

    few = best(predictions, "few_shot_samples", [run, "true"], per_class, "idx")
    unsure = best(predictions, "high_entropy_samples", [run], top, F.desc("entropy"), "idx")
    wrong = best(predictions.where("pred <> `true`"), "hard_negative_samples", [run], top, F.desc("conf"), "idx")
    return few.unionByName(unsure).unionByName(wrong)


def contexts(rows: DataFrame, function: str = "sample_context") -> DataFrame:
    """The function over candidate rows, a partition a run."""
    spark = rows.sparkSession
    if function == "sample_context":
        register(spark)
    return spark.sql(f"SELECT * FROM {function}(TABLE({{rows}}) PARTITION BY run ORDER BY (kind, place))", rows=rows)
