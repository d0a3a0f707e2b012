"""Evaluation by generation with a cache of replies that outlives the session.

The cache is a folder of Parquet tables, one for each (training version, model, split, limit); its
name is a digest of those four, so a model that was trained further finds nothing of the old one.
Rows are content-addressed by the digest of their prompt: an evaluation anti-joins its distinct
prompts with the table, calls the model for what is missing only, and appends the replies. Two
evaluations that append at once may write a prompt twice; readers take one row a prompt.
Compaction writes a table anew as one generation of files and then drops the older ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Made once a task, on the executor: replies to a batch of prompts, in order, always the same for the same prompt.
Generator = Callable[[], Callable[[list[str]], list[str]]]
SCHEMA = "prompt_sha string, reply string"


@dataclass(frozen=True)
class Key:
    version: int
    model: str
    split: str
    limit: int | None = None

    @property
    def digest(self) -> str:
        return sha256(json.dumps([self.version, self.model, self.split, self.limit]).encode()).hexdigest()


def generated(prompts: DataFrame, model: Generator) -> DataFrame:
    """prompt_sha and reply of prompts (prompt_sha, prompt); the model sees an Arrow batch at once."""

    def run(batches):
        say = model()
        for batch in batches:
            told = say(batch.column(1).to_pylist()) if batch.num_rows else []
            if len(told) != batch.num_rows:
                raise ValueError(f"{len(told)} replies to {batch.num_rows} prompts")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["prompt_sha", "reply"])

    return prompts.select("prompt_sha", "prompt").mapInArrow(run, SCHEMA)


class Cache:
    """Replies below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _folder(self, key: Key) -> str:
        return f"{self.root}/key={key.digest}"

    def _generations(self, key: Key) -> list[str]:
        fs, place = self._fs(self._folder(key))
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []

    def rows(self, key: Key) -> DataFrame:
        """One row a prompt."""
        there = self._generations(key)
        if not there:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*there).groupBy("prompt_sha").agg(F.min("reply").alias("reply"))

    def _append(self, key: Key, rows: DataFrame) -> None:
        """The rows as one more generation, which appears by a rename when it is whole."""
        name = uuid.uuid4().hex
        part = f"{self.root}/.part-{name}"
        rows.write.parquet(part)
        fs, target = self._fs(f"{self._folder(key)}/{name}")
        fs.mkdirs(target.getParent())
        if not fs.rename(self._fs(part)[1], target):
            raise OSError(f"could not move {part}")

    def replies(self, rows: DataFrame, prompt: str, model: Generator, key: Key, order: str) -> DataFrame:
        """The first ``key.limit`` rows by order (all, if None) with the reply to each and whether it was known before; null prompts get null replies."""
        some = rows if key.limit is None else rows.orderBy(order).limit(key.limit)
        asked = some.withColumn("_sha", F.sha2(F.col(prompt), 256))
        known = self.rows(key)
        lacking = asked.where("_sha is not null").groupBy(F.col("_sha").alias("prompt_sha")).agg(F.any_value(prompt).alias("prompt")).join(known, "prompt_sha", "left_anti")
        old = known.select("prompt_sha", F.lit(True).alias("_known"))
        if not lacking.isEmpty():
            before = self._generations(key)
            self._append(key, generated(lacking, model))
            old = self.spark.read.schema(SCHEMA).parquet(*before).select("prompt_sha", F.lit(True).alias("_known")).distinct() if before else self.spark.createDataFrame([], "prompt_sha string, _known boolean")
        told = self.rows(key).join(old, "prompt_sha", "left").select(F.col("prompt_sha").alias("_sha"), F.col("reply").alias("reply"), F.coalesce("_known", F.lit(False)).alias("cached"))
        return asked.join(told, "_sha", "left").drop("_sha")

    def compact(self, key: Key) -> int:
        """One generation of files instead of several; how many went."""
        old = self._generations(key)
        if len(old) < 2:
            return 0
        self._append(key, self.rows(key).repartition(F.col("prompt_sha")))
        for path in old:
            fs, place = self._fs(path)
            fs.delete(place, True)
        return len(old)

    def forget(self, key: Key) -> None:
        fs, place = self._fs(self._folder(key))
        fs.delete(place, True)


def evaluated(replies: DataFrame, gold: str, normal: Callable[[Column], Column], labels: list[str] | None = None) -> DataFrame:
    """Records of an evaluation: the replies with their compared form, whether that is a label (of those given), and whether it is the gold one."""
    said, meant = normal(F.col("reply")), normal(F.col(gold))
    valid = said.isin(labels) if labels is not None else said != ""
    return replies.withColumn("normalized_prediction", said).withColumn("prediction_is_valid_label", F.coalesce(valid, F.lit(False))).withColumn("exact_match", F.coalesce(said == meant, F.lit(False)))
