"""Metrics and samples from predictions: rows of idx, pred, true, conf, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: list[str] = []) -> DataFrame:
    """Support, predictions and hits of each label that occurs as truth or prediction."""
    told = pred.groupBy(*keys, "true", "pred").agg(F.count("*").alias("n"))
    hit = (F.col("true") == F.col("pred")).cast("int") * F.col("n")
    both = F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"))))
    rows = told.select(*keys, both.alias("x")).select(*keys, "x.*")
    return rows.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def per_label(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where undefined."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hits", "predicted"), zero), F.coalesce(F.try_divide("hits", "support"), zero)
    rows = counts.withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def classification_metrics(pred: DataFrame, keys: list[str] = [], classes: int | None = None) -> DataFrame:
    """Accuracy and P/R/F1: of label 1 if there are two classes and both occur, else the mean over labels that occur."""
    labels = per_label(confusion(pred, keys))
    ones, n = F.max(F.when(F.col("label") == 1, F.struct("precision", "recall", "f1"))), F.count("*")
    means = F.struct(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    g = labels.groupBy(*keys).agg(n.alias("n_labels"), F.sum("support").alias("n"), F.sum("hits").alias("hits"), ones.alias("one"), means.alias("macro"))
    binary = (F.col("n_labels") == 2) & F.col("one").isNotNull() & F.lit(classes == 2)
    return g.select(*keys, "n", F.try_divide("hits", "n").alias("accuracy"), *[F.when(binary, F.col(f"one.{c}")).otherwise(F.col(f"macro.{c}")).alias(c) for c in ("precision", "recall", "f1")])


def classification_report(pred: DataFrame) -> DataFrame:
    """A row per label, then accuracy, macro and weighted averages."""
    labels = per_label(confusion(pred)).persist()
    rows = labels.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    weight = F.sum("support")

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / weight

    accuracy = labels.agg((F.sum("hits") / weight).alias("a"), weight.alias("support")).select(F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    macro = labels.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], weight.alias("support"))
    weighted = labels.agg(F.lit("weighted avg").alias("label"), *[mean(c).alias(c) for c in ("precision", "recall", "f1")], weight.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def generation_summary(records: DataFrame, canonical: list) -> DataFrame:
    """Exact match, share of invalid labels, and macro F1 over observed and over all canonical labels."""
    valid = F.array(*[F.lit(c) for c in canonical])
    flat = records.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("true")).cast("int")).alias("exact_match"), F.avg((~F.coalesce(F.array_contains(valid, F.col("pred")), F.lit(False))).cast("int")).alias("invalid_label_rate"))
    labels = per_label(confusion(records)).where(F.array_contains(valid, F.col("label")))
    f1 = labels.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), (F.sum(F.when(F.col("support") > 0, F.col("f1")).otherwise(0.0)) / len(canonical)).alias("macro_f1_full"))
    # Both sides are one row.
    return flat.crossJoin(F.broadcast(f1))


def high_entropy(pred: DataFrame, k: int = 10) -> DataFrame:
    """The k most uncertain rows, ties by index; never a full sort."""
    return pred.where("entropy is not null").orderBy(F.desc("entropy"), "idx").limit(k)


def hard_negatives(pred: DataFrame, k: int = 10, at_least: float | None = None) -> DataFrame:
    """The k most confident errors."""
    wrong = pred.where("pred <> `true`")
    return (wrong.where(F.col("conf") >= at_least) if at_least is not None else wrong).orderBy(F.desc("conf"), "idx").limit(k)


def misclassified(pred: DataFrame) -> DataFrame:
    return pred.where("pred <> `true`")


def policy_features(pred: DataFrame, classes: int) -> DataFrame:
    """Error, low-confidence and hard-error rates, mean entropy (and over ln classes), and the share of the commonest confusion."""
    wrong, n = F.col("pred") != F.col("true"), F.count("*")
    flat = pred.agg(
        n.alias("n"), F.avg(wrong.cast("int")).alias("error_rate"), F.avg((F.col("conf") < 0.6).cast("int")).alias("low_confidence_rate"), F.avg((wrong & (F.col("conf") >= 0.8)).cast("int")).alias("hard_error_rate"),
        F.avg("entropy").alias("entropy_mean"), (F.avg("entropy") / F.ln(F.lit(float(classes)))).alias("entropy_normalized_mean"),
    )
    worst = pred.where(wrong).groupBy("true", "pred").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("worst"))
    return flat.crossJoin(F.broadcast(worst)).withColumn("max_confusion_rate", F.try_divide("worst", "n")).drop("worst")


def label_scores_decoded(losses: DataFrame, row: str = "idx", label: str = "label", loss: str = "loss") -> DataFrame:
    """The label of least loss (ties by label) with its probability among softmax(-loss)."""
    w = Window.partitionBy(row)
    share = F.exp(-F.col(loss)) / F.sum(F.exp(-F.col(loss))).over(w)
    return losses.withColumn("p", share).groupBy(row).agg(F.min(F.struct(F.col(loss).alias("l"), F.col(label).alias("y"), F.col("p").alias("p"))).alias("best")).select(row, F.col("best.y").alias("pred"), F.col("best.p").alias("conf"))
