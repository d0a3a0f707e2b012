"""Datasets by split, label dictionaries, snapshots and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that may hold a label, or a label's name, in order of preference.
LABELS, LABEL_NAMES = ("label", "labels", "class", "classes"), ("label_text", "label_name", "class_name", "category")


def load_options(options: dict, revision: str | None) -> dict:
    """Reader options with the pinned revision; two different ones raise."""
    given = options.get("revision")
    if given and revision and given != revision:
        raise ValueError("conflicting dataset revisions")
    return options | ({"revision": revision} if revision else {})


def load(spark: SparkSession, data_files: str | list | dict, kind: str = "json", schema: str | None = None) -> DataFrame:
    """Rows of all files with a column split: the keys of a mapping, else train."""
    by_split = data_files if isinstance(data_files, dict) else {"train": data_files}

    def read(paths) -> DataFrame:
        reader = spark.read.format(kind).option("mode", "FAILFAST") if kind == "json" else spark.read.format(kind)
        return (reader.schema(schema) if schema else reader).load(paths)

    parts = [read(paths).withColumn("split", F.lit(name)) for name, paths in by_split.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def num_labels(rows: DataFrame) -> int | None:
    """Classes by the names in a label column's metadata, else by its distinct values; None without such a column."""
    name = next((c for c in LABELS if c in rows.columns), None)
    if name is None:
        return None
    names = rows.schema[name].metadata.get("names")
    return len(names) if names else rows.agg(F.count_distinct(name)).first()[0]


def label_names(rows: DataFrame, label: str, order: str, first: int = 1000) -> DataFrame:
    """label and name: the first name that goes with it among the first rows."""
    name = next((c for c in LABEL_NAMES if c in rows.columns), None)
    if name is None:
        return rows.select(label).distinct().select(label, F.col(label).cast("string").alias("name"))
    return rows.where(F.col(order) < first).groupBy(label).agg(F.min_by(name, order).alias("name"))


def decoded(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    """rows with label_text: the class name, else the label as text."""
    table = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return rows.withColumn("label_text", F.coalesce(F.get(table, F.col(label).try_cast("int")), F.col(label).cast("string")))


def latest_snapshots(paths: DataFrame) -> DataFrame:
    """dir, snapshot and cycle: of each directory the dataset_cycle_N of greatest number. paths has a column path."""
    rows = paths.select(F.regexp_extract("path", r"^(.*)/dataset_cycle_([0-9]+)(/|$)", 1).alias("dir"), F.regexp_extract("path", r"^(.*/dataset_cycle_([0-9]+))(/|$)", 1).alias("snapshot"), F.regexp_extract("path", r"/dataset_cycle_([0-9]+)(/|$)", 1).alias("n")).where("n <> ''")
    return rows.groupBy("dir").agg(F.max_by("snapshot", F.col("n").cast("int")).alias("snapshot"), F.max(F.col("n").cast("int")).alias("cycle"))


def latest_model(paths: DataFrame, experiment: str) -> DataFrame:
    """The newest directory (by name) of an experiment."""
    return paths.where(F.element_at(F.split("path", "/"), -1).startswith(experiment)).agg(F.max("path").alias("path"))


def plan_rows(documents: DataFrame, key: str = "control_name") -> DataFrame:
    """Rows of a plan file's JSON text (column doc) with a column error: what is wrong with a row, or with the file."""
    item = "array<map<string,string>>"
    rows = documents.select("doc", F.from_json("doc", item).alias("items"))
    bad = F.when(F.col("doc").isNull(), "missing").when(F.col("items").isNull(), "not a list of objects")
    each = rows.withColumn("error", bad).select("error", F.explode_outer("items").alias("item"))
    return each.select("item", F.coalesce("error", F.when(F.try_element_at("item", F.lit(key)).isNull(), F.lit("no key"))).alias("error"))
