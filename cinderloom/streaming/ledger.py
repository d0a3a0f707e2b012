"""The attempt log as a stream: a running ledger per run. The reference has no streams; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.plans import bindings
from cinderloom.sources.staging import new_folder


def running_ledger(attempts: DataFrame) -> DataFrame:
    """Spent tokens and attempts per run, of a batch or a stream."""
    return attempts.groupBy("run_id").agg(F.sum(F.coalesce("ledger", F.lit(0.0))).alias("spent"), F.count("*").alias("attempts"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a file stream with the attempts' columns that the ledger needs."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    kind = F.col("event_type")
    # A file stream reads a folder; the filter leaves it the one table.
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt_id"), F.when(~kind.isin("signup"), F.col("value")).alias("ledger"))


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of run_id, attempt_id, ord, tokens and ts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt_id"), F.col("event_id").alias("ord"), F.when(~F.col("event_type").isin("signup"), F.col("value")).alias("tokens"), "ts")


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after all that is there now has streamed through (``availableNow``)."""
    place = new_folder(spark, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/{batch}")
        done.append(batch)

    # The whole ledger of the last batch, written by the executors: nothing passes through the driver.
    done: list[int] = []
    stream = running_ledger(events_stream(spark, sf_dir))
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_ledger(bindings.attempts(spark, sf_dir))
