"""Run artifacts as DataFrames: discovery, whole-file JSON and YAML, logs, cycle metrics, token ledgers.

All files of a tree are one scan; which directories are runs, and what each file says, are
columns of it. Nothing is listed or parsed on the driver.
"""

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The files that make a directory a run.
REQUIRED = ("run_manifest.json", "experiment_config.yaml", "metrics.json", "token_usage.json")
#: Metrics of a cycle that are no quality values start with this.
META = "_"

USAGE = "struct<input_tokens:long,output_tokens:long,total_tokens:long,estimated_cost:double>"
ATTEMPT = (
    "run_id string, attempt_id string, decision_id string, cycle int, status string, failure_type string, "
    f"predicted_cost struct<total_tokens:double,allowed:boolean>, provider_reported_cost {USAGE}, ledger_debit_cost {USAGE}, ledger_debit_source string, realized_cost {USAGE}, "
    "budget_before struct<tokens_remaining:double>, budget_after struct<tokens_remaining:double>, metadata struct<error:string,records_parsed:long,records_accepted:long,records_requested:long>"
)
DECISION = (
    "run_id string, decision_id string, cycle int, policy_name string, action_name string, action struct<name:string,prompt_operator:string,teacher_tier:string,batch_size:int,is_stop:boolean>, "
    "action_scores map<string,double>, metadata struct<feasible_actions:array<string>,acquisition_outcome:string,records_added:long>"
)


def files(spark: SparkSession, *roots: str) -> DataFrame:
    """dir, name and content of every artifact below the roots; a directory that two roots reach counts once."""
    names = (*REQUIRED, "policy_decisions.jsonl", "teacher_attempts.jsonl")
    # Other files, models and data sets among them, are listed and not read.
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(names)}}}")
    parts = [read.load(r).select("path", "content") for r in roots]
    rows = reduce(DataFrame.unionByName, parts)
    path = F.regexp_replace("path", "^file:/*", "/")
    named = rows.select(F.regexp_extract(path, "^(.*)/([^/]+)$", 1).alias("dir"), F.regexp_extract(path, "^(.*)/([^/]+)$", 2).alias("name"), F.decode("content", "UTF-8").alias("content"))
    return named.dropDuplicates(["dir", "name"])


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of a few paths that is there, on whatever file system its address names."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return path
    return None


def calibration_csv(spark: SparkSession, report_dir: str) -> DataFrame | None:
    """The calibration table of a report: its own, its audit's or that of the audit beside it; None where there is none."""
    root = report_dir.rstrip("/")
    path = first_existing(spark, f"{root}/teacher_calibration.csv", f"{root}/audit/teacher_calibration.csv", f"{root.rsplit('/', 1)[0]}/audit/teacher_calibration.csv")
    return spark.read.option("header", "true").csv(path) if path else None


def run_dirs(found: DataFrame) -> DataFrame:
    """Directories that hold all required files; below a run no other is looked for."""
    runs = found.where(F.col("name").isin(*REQUIRED)).groupBy("dir").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(REQUIRED)).select("dir")
    above = runs.select(F.col("dir").alias("parent"))
    # The parents of a path are its prefixes: an equi-join on them, no comparison of all pairs.
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/")) - 1), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
    nested = runs.select("dir", F.explode(steps).alias("parent")).join(above, "parent").select("dir")
    return runs.join(nested, "dir", "left_anti")


def yaml_as_json(column: Column) -> Column:
    """YAML documents as JSON text; Spark has no YAML reader."""

    def convert(texts: pd.Series) -> pd.Series:
        import yaml

        return texts.map(lambda t: None if t is None else json.dumps(yaml.safe_load(t), default=str))

    return F.pandas_udf(convert, "string")(column)


def documents(found: DataFrame, name: str) -> DataFrame:
    """dir and doc: the top level of a JSON (or YAML) file as a map from key to JSON text."""
    text = yaml_as_json(F.col("content")) if name.endswith(".yaml") else F.col("content")
    return found.where(F.col("name") == name).select("dir", F.from_json(text, "map<string,string>").alias("doc"))


def log(found: DataFrame, name: str, schema: str) -> DataFrame:
    """Lines of a JSONL log with their place ord in the file; a malformed line raises."""
    rows = found.where(F.col("name") == name).select("dir", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).where(F.trim("line") != "")
    return rows.select("dir", "ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("dir", "ord", "x.*")


def cycle_metrics(found: DataFrame) -> DataFrame:
    """dir, cycle, metric, value of every numeric key of metrics.json."""
    rows = documents(found, "metrics.json").select("dir", F.explode("doc").alias("k", "v")).where(F.col("k").rlike("^[0-9]+$"))
    each = rows.select("dir", F.col("k").cast("int").alias("cycle"), F.explode(F.from_json("v", "map<string,string>")).alias("metric", "text"))
    return each.select("dir", "cycle", "metric", "text", F.col("text").try_cast("double").alias("value"))


def heldout(found: DataFrame) -> DataFrame:
    """dir and heldout: the map of held-out test metrics."""
    return documents(found, "metrics.json").select("dir", F.from_json(F.try_element_at("doc", F.lit("heldout_test")), "map<string,string>").alias("heldout"))


def token_cycles(found: DataFrame) -> DataFrame:
    """dir, cycle, tokens of each cycle, and the running total."""
    usage = f"array<struct<cycle:int,operations:map<string,{USAGE}>,cycle_total:{USAGE}>>"
    rows = documents(found, "token_usage.json").select("dir", F.posexplode(F.from_json(F.try_element_at("doc", F.lit("per_cycle")), usage)).alias("pos", "c"))
    return rows.select("dir", F.coalesce("c.cycle", "pos").alias("cycle"), F.coalesce("c.cycle_total.total_tokens", F.lit(0)).alias("tokens"), F.col("c.operations").alias("operations"))


def grand_total(found: DataFrame) -> DataFrame:
    return documents(found, "token_usage.json").select("dir", F.coalesce(F.from_json(F.try_element_at("doc", F.lit("grand_total")), USAGE)["total_tokens"], F.lit(0)).alias("grand_tokens"), F.coalesce(F.from_json(F.try_element_at("doc", F.lit("totals")), f"map<string,{USAGE}>")["sft_data"]["total_tokens"], F.lit(0)).alias("seed_tokens"))


def text(doc: Column, key: str) -> Column:
    return F.try_element_at(doc, F.lit(key))


def contexts(found: DataFrame) -> DataFrame:
    """dir and the identity of each run: the manifest's values, the config's where it lacks them."""
    m, c = documents(found, "run_manifest.json").withColumnRenamed("doc", "m"), documents(found, "experiment_config.yaml").withColumnRenamed("doc", "c")
    both = lambda k: F.coalesce(text(F.col("m"), k), text(F.col("c"), k))
    keys = ("dataset", "student_model", "student_type", "policy_name", "seed", "token_budget", "synthetic_record_budget")
    rows = m.join(c, "dir")
    return rows.select(
        "dir", text(F.col("m"), "run_id").alias("run_id"), text(F.col("m"), "status").alias("status"), text(F.col("m"), "control_name").alias("control_name"), F.coalesce(text(F.col("c"), "name"), text(F.col("m"), "experiment")).alias("experiment"), text(F.col("m"), "selection_split").alias("selection_split"),
        text(F.col("m"), "dataset_subset").alias("dataset_subset"), F.coalesce(text(F.col("m"), "paper_mode") == "true", F.lit(False)).alias("paper_mode"), text(F.col("m"), "cycles_completed").try_cast("int").alias("cycles_completed"), text(F.col("m"), "expected_cycles").try_cast("int").alias("expected_cycles"), *[both(k).alias(k) for k in keys],
    ).withColumns({k: F.col(k).try_cast("double") for k in ("token_budget", "synthetic_record_budget")})


def attempts(found: DataFrame) -> DataFrame:
    """The attempt log in the shape that the ledger operators take."""
    rows = log(found, "teacher_attempts.jsonl", ATTEMPT)
    return rows.select(
        F.col("dir").alias("run_id"), "ord", "attempt_id", "decision_id", "cycle", "status", F.col("predicted_cost.total_tokens").alias("predicted"), F.col("ledger_debit_cost.total_tokens").cast("double").alias("ledger"), F.coalesce("provider_reported_cost.total_tokens", F.when(F.col("ledger_debit_source") == "provider_reported", F.col("realized_cost.total_tokens"))).cast("double").alias("provider"),
        F.col("budget_before.tokens_remaining").alias("before"), F.col("budget_after.tokens_remaining").alias("after"), "failure_type", "metadata",
    )
