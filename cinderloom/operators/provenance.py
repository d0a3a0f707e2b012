"""Where runs and their seed data come from: the provenance audit and the tokens that seed data cost.

Runs, data files and manifests are three tables that meet on paths; files are hashed where they
are read. Nothing is opened on the driver. A data file and its manifest are one row each, as
their digest needs all bytes; files of training prompts are far below Spark's 2 GB for a value.
"""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.functions.scalars import lenient_long
from cinderloom.sources import artifacts

# What a manifest has to say, and where its keys stand.
SECTIONS = ("source_control", "runtime", "hardware", "config_provenance", "dataset_source", "models")
ACCOUNTS = ("accepted_records", "rejected_records", "teacher_gold_agreement_records", "teacher_gold_disagreement_records", "teacher_gold_disagreement_rate")
TOKENS = ("teacher_input_tokens", "teacher_output_tokens", "teacher_total_tokens")
SUFFIX, SCHEMA_VERSION = ".manifest.json", 3


def _at(doc: Column, *keys: str) -> Column:
    """The JSON text below nested keys; null if one is absent."""
    for i, k in enumerate(keys):
        doc = F.try_element_at(F.from_json(doc, "map<string,string>") if i else doc, F.lit(k))
    return doc


def _said(text: Column) -> Column:
    """Whether a JSON value is there and not empty, zero or false."""
    return F.coalesce(~F.trim(text).isin("", "{}", "[]", "null", "false", "0"), F.lit(False))


def _number(doc: Column, key: str) -> Column:
    return F.coalesce(lenient_long(_at(doc, key)), F.lit(0))


def _path(column: str) -> Column:
    return F.regexp_replace(column, "^file:/*", "/")


def config_hash(texts: Column) -> Column:
    """Digest of YAML documents as JSON with sorted keys; null for empty ones and those that don't parse."""

    def digest(values: pd.Series) -> pd.Series:
        import yaml

        def one(t):
            try:
                config = yaml.safe_load(t or "")
                return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest() if config else None
            except (yaml.YAMLError, TypeError):
                return None

        return values.map(one)

    return F.pandas_udf(digest, "string")(texts)


def configured_files(found: DataFrame) -> DataFrame:
    """dir and file: the data files that each run's configuration names as text, list or mapping, in no order."""
    listed = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    named = _at(F.col("doc"), "dataset_kwargs", "data_files")
    every = F.when(named.startswith("{"), F.flatten(F.transform(F.map_values(F.from_json(named, "map<string,string>")), listed))).otherwise(listed(named))
    return artifacts.documents(found, "experiment_config.yaml").select("dir", F.explode(every).alias("file")).where("file is not null")


def _counted(lines: Column, key: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(lenient_long(F.get_json_object(x, f"$.{key}")), F.lit(0)))


def materialized(spark: SparkSession, *roots: str) -> DataFrame:
    """One row per data file with a manifest below the roots: path, doc (the manifest) and whether its sections, accounts, digests and tokens hold."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    manifests = read.option("pathGlobFilter", f"*{SUFFIX}").load(list(roots))
    told = manifests.select(F.regexp_replace(_path("path"), r"\.manifest\.json$", "").alias("path"), F.from_json(F.decode("content", "UTF-8"), "map<string,string>").alias("doc")).dropDuplicates(["path"])
    # A name does not tell data files apart from others, but only the join reads what it needs of the rest.
    data = read.option("pathGlobFilter", "*.json*").load(list(roots)).select(_path("path").alias("path"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("content")).where(~F.col("path").endswith(SUFFIX)).dropDuplicates(["path"])
    lines = F.filter(F.transform(F.split("content", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = told.join(data, "path").withColumn("lines", lines)
    doc, n = F.col("doc"), F.size("lines").cast("long")
    count = lambda k: F.when(F.map_contains_key(doc, F.lit(k)), _number(doc, k)).otherwise(n)
    whole = (_at(doc, "artifact_sha256") == F.col("sha")) & (_number(doc, "records") == n)
    same = F.coalesce(F.from_json(_at(doc, "records_sha256"), "array<string>"), F.array().cast("array<string>")) == F.transform("lines", lambda x: F.sha2(x, 256))
    parsed = F.forall("lines", lambda x: F.try_parse_json(x).isNotNull())
    tokens = parsed & (count("accepted_records") == n) & (count("attempted_records") >= count("accepted_records"))
    for k in TOKENS:
        tokens = tokens & (_counted(F.col("lines"), k) == _number(doc, k))
    has = lambda text, keys: F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(text, k))
    sections = has(F.from_json(_at(doc, "reproducibility"), "map<string,string>"), SECTIONS)
    checks = {"sections_ok": sections, "accounts_ok": has(doc, ACCOUNTS), "integrity_ok": whole & same, "tokens_ok": tokens}
    return rows.select("path", "doc", *[F.coalesce(ok, F.lit(False)).alias(k) for k, ok in checks.items()])


def seed_files(found: DataFrame, made: DataFrame, base: str | None = None) -> DataFrame:
    """dir, file and the columns of made, null where no file with a manifest is found.

    A path that is not absolute is looked up below base (the working directory), the run and its parent, in this order.
    """
    named, base = configured_files(found).withColumn("no", F.monotonically_increasing_id()), base or os.getcwd()
    at = F.when(F.col("file").startswith("/"), F.array("file")).otherwise(F.array(*[F.concat(p, F.lit("/"), "file") for p in (F.lit(base), F.col("dir"), F.regexp_replace("dir", "/[^/]+$", ""))]))
    tried = named.select("dir", "file", F.posexplode(at).alias("place", "path"))
    first = tried.join(made, "path").groupBy("dir", "file").agg(F.min_by(F.struct("path", *[c for c in made.columns if c != "path"]), "place").alias("hit"))
    return named.join(first, ["dir", "file"], "left").select("dir", "file", "hit.*")


def audit(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """dir, passed, failure_reasons (joined by semicolons) and the counts of data files of every run."""
    good = {f"{k}_files": F.count_if(k) for k in ("sections_ok", "accounts_ok", "integrity_ok", "tokens_ok")}
    files = seeds.groupBy("dir").agg(F.count("*").alias("data_files"), F.count("path").alias("manifests"), *[c.alias(k) for k, c in good.items()])
    copy = found.where("name = 'experiment_config.yaml'").select("dir", F.sha2("content", 256).alias("copy_sha"), config_hash(F.col("content")).alias("own_hash"))
    rows = artifacts.documents(found, "run_manifest.json").join(copy, "dir", "left").join(files, "dir", "left").na.fill(0, ["data_files", "manifests", *good])
    doc = F.col("doc")
    repro = lambda *keys: _at(doc, "reproducibility", *keys)
    hashed, copied = _at(doc, "config_hash"), repro("config_provenance", "run_copy_sha256")
    package, workspace = (lambda k, side=side: repro("source_control", side, k) for side in ("package", "workspace"))
    bad = {"run_manifest_schema_version_lt_3": _number(doc, "schema_version") < SCHEMA_VERSION, "missing_run_reproducibility": ~_said(repro())}
    bad |= {f"missing_{k}": ~_said(repro(k)) for k in SECTIONS[:4]}
    bad |= {
        "missing_config_run_copy_sha256": ~_said(copied), "missing_config_hash": ~_said(hashed), "config_hash_mismatch": _said(hashed) & ~hashed.eqNullSafe(F.col("own_hash")), "config_run_copy_sha256_mismatch": _said(copied) & ~copied.eqNullSafe(F.col("copy_sha")),
    }
    bad |= {f"missing_{k}": ~_said(repro(k)) for k in SECTIONS[4:]}
    bad |= {"missing_package_head_sha": ~_said(package("head_sha")), "missing_workspace_head_sha": ~_said(workspace("head_sha"))}
    bad |= {f"missing_{name}_sha256": ~_said(F.try_element_at(F.from_json(repro("runtime", "lockfiles"), "map<string,string>"), F.lit(f))) for name, f in (("pyproject", "pyproject.toml"), ("uv_lock", "uv.lock"))}
    bad |= {"dirty_package_git": _said(package("is_dirty")), "dirty_workspace_git": _said(workspace("is_dirty")), "missing_materialized_manifests": F.col("manifests") < F.col("data_files")}
    kinds = {"missing_materialized_manifest_provenance": "sections_ok", "missing_materialized_manifest_accounting": "accounts_ok", "materialized_manifest_integrity_mismatch": "integrity_ok", "materialized_manifest_token_accounting_mismatch": "tokens_ok"}
    bad |= {reason: F.col(f"{k}_files") < F.col("manifests") for reason, k in kinds.items()}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(b, F.lit(reason)) for reason, b in bad.items()])), ";")
    return rows.withColumn("failure_reasons", reasons).select("dir", (F.col("failure_reasons") == "").alias("passed"), "failure_reasons", "data_files", "manifests", *good)


def seed_tokens(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """dir, manifests, estimated_records and seed, online and all teacher tokens (in, out, total) of every run.

    Manifests count once. Where they have no tokens, those charged to the run's usage stand in.
    """
    parts = ("input_tokens", "output_tokens", "total_tokens")
    once = seeds.where("path is not null").dropDuplicates(["dir", "path"])
    paid = once.groupBy("dir").agg(F.count("*").alias("manifests"), F.sum(_number(F.col("doc"), "usage_estimated_records")).alias("estimated_records"), *[F.sum(_number(F.col("doc"), f"teacher_{p}")).alias(p) for p in parts])
    usage = artifacts.documents(found, "token_usage.json")
    at = lambda p, *keys: F.coalesce(lenient_long(_at(F.col("doc"), *keys, p)), F.lit(0))
    told = usage.select("dir", *[at(p, "totals", "sft_data").alias(f"charged_{p}") for p in parts], *[at(p, "grand_total").alias(f"all_{p}") for p in parts])
    rows = told.join(paid, "dir", "left").na.fill(0)
    total, charged = F.col("total_tokens"), F.col("charged_total_tokens")
    instead = (total <= 0) | ((charged == total) & (F.col("input_tokens") <= 0) & (F.col("output_tokens") <= 0))
    seed = {p: F.when(instead, F.col(f"charged_{p}")).otherwise(F.col(p)) for p in parts}
    online = {p: F.when(charged > 0, F.greatest(F.lit(0), F.col(f"all_{p}") - F.col(f"charged_{p}"))).otherwise(F.col(f"all_{p}")) for p in parts}
    return rows.select("dir", "manifests", "estimated_records", *[seed[p].alias(f"seed_{p}") for p in parts], *[online[p].alias(f"online_{p}") for p in parts], *[(seed[p] + online[p]).alias(f"all_{p}") for p in parts])
