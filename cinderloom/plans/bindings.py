"""Bindings of the reference tables to the engine's silver views, in DataFrames and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderloom.functions.scalars import argmax, entropy, softmax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; dimension tables are small and fixed, so Spark broadcasts them by their size."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    return t("orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("run_id"), F.col("r_name").alias("dataset"), F.col("n_name").alias("subset"), F.col("o_orderpriority").alias("policy"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("control"),
        (F.col("o_orderkey") % 3).cast("int").alias("seed"), (25000 * (1 + F.col("o_custkey") % 3)).cast("long").alias("budget"), F.col("o_totalprice").alias("final"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of each policy and match key that has no control."""
    key = ["dataset", "subset", "policy", "seed", "budget"]
    last = runs(spark, sf_dir).where("control = ''").groupBy(*key).agg(F.max("run_id").alias("run_id"), F.max_by("final", "run_id").alias("final"))
    return last.select("run_id", *key, F.lit("").alias("control"), "final")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("cycle"))
    return g.agg(F.sum("l_quantity").alias("tokens"), F.round(F.avg("l_discount"), 9).alias("metric"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as teacher attempts, with the tokens left of 5,000 before and after each."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    status = F.when(kind.isin("view", "click"), "success").when(kind == "error", "failed").when(kind == "purchase", "budget_violation").otherwise("masked")
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt_id"), F.col("event_id").alias("ord"), (k % 5).alias("cycle"), status.alias("status"), k.alias("k"), F.col("value"),
        F.when(k % 3 == 0, "coverage").when(k % 3 == 1, "boundary").otherwise("repair").alias("operation"),
    )
    paid = base.select(
        "run_id", "attempt_id", "ord", "cycle", "status", "operation", F.when(F.col("k") != 7, 5.0 * F.col("k")).alias("predicted"), F.when(F.col("status") != "masked", F.col("value")).alias("ledger"), F.when(F.col("status") == "success", F.col("value")).alias("provider")
    )
    w = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    spent = paid.withColumn("spent", F.sum(F.coalesce("ledger", F.lit(0.0))).over(w))
    before = 5000 - F.col("spent") + F.coalesce("ledger", F.lit(0.0))
    slip = F.when(F.col("attempt_id") % 97 == 0, 1.0).otherwise(0.0)
    return spent.withColumn("before", before).withColumn("after", 5000 - F.col("spent") + slip).drop("spent")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 20)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), logits.alias("logits"), F.col("label").alias("true"), softmax(logits).alias("probs"))
    return rows.select("idx", argmax(F.col("logits")).alias("pred"), "true", F.array_max("probs").alias("conf"), entropy(F.col("probs")).alias("entropy"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), cycle.cast("int").alias("origin_cycle"), F.when(cycle == 0, "train").otherwise("augmented").alias("source_split"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the truth and absence of toxicity as a prediction of it."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), (1 - F.col("toxic")).alias("pred"), F.col("quality").alias("true"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as policy states, with features derived from their keys."""
    r = runs(spark, sf_dir)
    part = lambda m: (F.col("run_id") % m).cast("double") / m
    return r.select(
        F.col("run_id").alias("state_id"), (F.col("run_id") % 4).cast("int").alias("cycle"), F.lit(5).alias("cycles"), F.col("budget").cast("double").alias("budget"), (F.col("budget") * part(7) / 5).alias("remaining"),
        part(11).alias("error"), part(13).alias("entropy"), part(17).alias("hard"), part(19).alias("confusion"), part(23).alias("synthetic_ratio"), part(7).alias("remaining_frac"),
    )


#: The same views for DuckDB.
SQL = {
    "v_runs": """SELECT o_orderkey AS run_id, r_name AS dataset, n_name AS subset, o_orderpriority AS policy, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS control,
        CAST(o_orderkey % 3 AS INTEGER) AS seed, CAST(25000 * (1 + o_custkey % 3) AS BIGINT) AS budget, o_totalprice AS final
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_cells": """SELECT max(run_id) AS run_id, dataset, subset, policy, seed, budget, '' AS control, arg_max(final, run_id) AS final FROM v_runs WHERE control = '' GROUP BY dataset, subset, policy, seed, budget""",
    "v_cycles": """SELECT l_orderkey AS run_id, l_linenumber AS cycle, sum(l_quantity) AS tokens, round(avg(l_discount), 9) AS metric FROM lineitem GROUP BY 1, 2""",
    "v_attempts": """SELECT run_id, attempt_id, ord, cycle, status, operation, predicted, ledger, provider, 5000 - spent + coalesce(ledger, 0) AS before, 5000 - spent + CASE WHEN attempt_id % 97 = 0 THEN 1 ELSE 0 END AS after
      FROM (SELECT *, sum(coalesce(ledger, 0)) OVER (PARTITION BY run_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS spent FROM (
        SELECT user_id AS run_id, event_id AS attempt_id, event_id AS ord, k % 5 AS cycle, status, CASE WHEN k <> 7 THEN 5.0::DOUBLE * k END AS predicted, CASE WHEN status <> 'masked' THEN value END AS ledger,
          CASE WHEN status = 'success' THEN value END AS provider, CASE k % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'boundary' ELSE 'repair' END AS operation
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type IN ('view', 'click') THEN 'success' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'budget_violation' ELSE 'masked' END AS status FROM events)))""",
    "v_pred": """SELECT idx, pred, "true", list_max(probs) AS conf, -list_sum(list_transform(probs, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS entropy
      FROM (SELECT idx, "true", pred, list_transform(powers, lambda x: x / list_sum(powers)) AS probs FROM (
        SELECT vec_id AS idx, label AS "true", CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, list_transform(z, lambda x: exp(x - list_max(z))) AS powers
        FROM (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 20) AS z FROM embeddings)))""",
    "v_train": """SELECT doc_id AS id, text, lang AS label, CAST(doc_id % 4 AS INTEGER) AS origin_cycle, CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE 'augmented' END AS source_split FROM documents""",
    "v_norm": """SELECT *, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM v_train""",
    "v_grams": """SELECT id, source_split, unnest(CASE WHEN len(toks) <= 5 THEN list_distinct(toks) ELSE list_distinct(list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i+4], ' '))) END) AS g FROM v_norm""",
    "v_sizes": """SELECT id, source_split, count(*) AS n FROM v_grams GROUP BY 1, 2""",
    "v_near": """SELECT a, b, c / CAST(na + nb - c AS DOUBLE) AS similarity, sb FROM (
        SELECT x.id AS a, y.id AS b, y.source_split AS sb, count(*) AS c FROM v_grams x JOIN v_grams y ON x.g = y.g WHERE x.source_split = 'augmented' AND (y.source_split = 'train' OR y.id < x.id) GROUP BY 1, 2, 3)
      JOIN (SELECT id, n AS na FROM v_sizes) p ON p.id = a JOIN (SELECT id, n AS nb FROM v_sizes) q ON q.id = b WHERE c / CAST(na + nb - c AS DOUBLE) >= 0.85""",
    "v_labels": """SELECT doc_id AS idx, 1 - toxic AS pred, quality AS "true" FROM labels""",
    "v_sft": """SELECT conv_id, turn, text, next_text FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
    "v_states": """SELECT run_id AS state_id, CAST(run_id % 4 AS INTEGER) AS cycle, 5 AS cycles, CAST(budget AS DOUBLE) AS budget, budget * ((run_id % 7)::DOUBLE / 7) / 5 AS remaining, (run_id % 11)::DOUBLE / 11 AS error, (run_id % 13)::DOUBLE / 13 AS entropy,
        (run_id % 17)::DOUBLE / 17 AS hard, (run_id % 19)::DOUBLE / 19 AS confusion, (run_id % 23)::DOUBLE / 23 AS synthetic_ratio, (run_id % 7)::DOUBLE / 7 AS remaining_frac FROM v_runs""",
    "v_actions": """SELECT o || ':' || t || ':b' || b AS action, o AS operator, t AS tier, b AS batch, false AS is_stop FROM (VALUES ('coverage'), ('boundary'), ('repair')) x(o), (VALUES ('cheap'), ('strong')) y(t), (VALUES (16), (32), (64)) z(b)
      UNION ALL SELECT 'STOP', NULL, NULL, 0, true""",
    "v_options": """SELECT * FROM (SELECT s.*, a.*, CASE WHEN is_stop THEN 0.0::DOUBLE ELSE batch * 64.0::DOUBLE * CASE WHEN tier = 'strong' THEN 2 ELSE 1 END END AS cost FROM v_states s, v_actions a) WHERE is_stop OR cost <= remaining""",
    "v_confusion": """SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
        SELECT "true" AS label, count(*) AS support, 0 AS predicted, sum(CASE WHEN pred = "true" THEN 1 ELSE 0 END) AS hits FROM v_pred GROUP BY 1 UNION ALL SELECT pred, 0, count(*), 0 FROM v_pred GROUP BY 1) GROUP BY 1""",
    "v_per_label": """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
        SELECT label, support, predicted, hits, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall FROM v_confusion)""",
}
#: Views that a view needs, in order.
NEEDS = {
    "v_cells": ("v_runs",), "v_states": ("v_runs",), "v_norm": ("v_train",), "v_grams": ("v_train", "v_norm"), "v_sizes": ("v_train", "v_norm", "v_grams"), "v_near": ("v_train", "v_norm", "v_grams", "v_sizes"),
    "v_options": ("v_runs", "v_states", "v_actions"), "v_confusion": ("v_pred",), "v_per_label": ("v_pred", "v_confusion"),
}


def with_views(sql: str) -> str:
    """The query with the views that it names as common table expressions."""
    names = [v for v in SQL if f"{v} " in f"{sql} ".replace(",", " ").replace(")", " ").replace("\n", " ")]
    every = [v for v in SQL if v in {n for x in names for n in (*NEEDS.get(x, ()), x)}]
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in every)
    if not every:
        return sql
    return f"WITH RECURSIVE {head}, {sql[len('WITH RECURSIVE '):]}" if sql.startswith("WITH RECURSIVE ") else f"WITH {head} {sql}"
