"""Deterministic samples, splits and shards. Order keys are explicit columns; nothing depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.operators.ranks import first_of_each, ranked


def seeded(seed: int, *columns: str) -> Column:
    """A pseudo-random order key: the same rows for the same seed, on any layout."""
    return F.xxhash64(F.lit(seed), *columns)


def per_class(rows: DataFrame, label: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each label in the given order. Spark's group limit leaves n rows a label and task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """Labels in turn (in their own order), each giving its next row, until k rows.

    A row beyond its label's first k can't be among them, so at most k rows a label and task move.
    """
    turn = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= k).orderBy("turn", label, order).limit(k)


def cover_then_fill(rows: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """The earliest row of each label (labels in order), then the earliest of the rest, k in all.

    What fills up stands among the k earliest rows of all: each of those that is not its label's
    first is filler, and there are enough of them. So a top-k and one row a label suffice, and no
    label's rows are gathered. ``order`` tells rows apart.
    """
    first = first_of_each(rows, [label], [order]).withColumn("covers", F.lit(True))
    early = rows.orderBy(order).limit(k)
    known = first.select(F.col(label).alias("_l"), F.col(order).alias("_o"))
    fill = early.join(known, F.col(label).eqNullSafe(F.col("_l")) & F.col(order).eqNullSafe(F.col("_o")), "left_anti").withColumn("covers", F.lit(False))
    return first.unionByName(fill).orderBy(F.desc("covers"), F.when(F.col("covers"), F.col(label)), order).limit(k)


def _train_size(n: Column, ratio: float) -> Column:
    return F.floor(n * ratio + 0.5)


def stratified_split(rows: DataFrame, label: str, train_ratio: float, *order: Column | str) -> DataFrame:
    """rows with a column split; each label gives floor(ratio n + 1/2) rows to train, exactly."""
    told = ranked(rows, [label], order, "_place", "_size")
    return told.withColumn("split", F.when(F.col("_place") <= _train_size(F.col("_size"), train_ratio), "train").otherwise("validation")).drop("_place", "_size")


def plain_split(rows: DataFrame, train_ratio: float, *order: Column | str) -> DataFrame:
    """rows with a column split: floor(ratio n + 1/2) of all rows to train, but one row at least to either side. Fewer than two rows can't be split."""
    told = ranked(rows, [], order, "_place", "_size")
    take = F.greatest(F.lit(1), F.least(F.col("_size") - 1, _train_size(F.col("_size"), train_ratio)))
    able = F.when(F.col("_size") < 2, F.raise_error(F.lit("a split needs two rows at least")).cast("string"))
    return told.withColumn("split", F.coalesce(able, F.when(F.col("_place") <= take, "train").otherwise("validation"))).drop("_place", "_size")


def shuffled_cap(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a shuffled order: a top-n, so each task sends n rows at most."""
    return rows.orderBy(*order).limit(n)


def stratified_sample(rows: DataFrame, label: str, size: int, *order: Column | str) -> DataFrame:
    """size rows with the labels' shares, by largest remainders (ties by label)."""
    told = ranked(rows, [label], order, "_place", "_c")
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    wanted = F.least(F.lit(size), F.col("_t"))
    quota = counts.crossJoin(F.broadcast(total)).withColumn("_q", F.col("_c") * wanted / F.col("_t")).withColumn("_base", F.floor("_q"))
    spare = quota.agg((F.any_value(wanted) - F.sum("_base")).alias("_left"))
    taken = ranked(quota, [], [F.desc(F.col("_q") - F.col("_base")), F.col(label)], "_turn").crossJoin(F.broadcast(spare))
    take = taken.select(F.col(label).alias("_l"), (F.col("_base") + (F.col("_turn") <= F.col("_left")).cast("int")).alias("_take"))
    return told.join(take, F.col(label).eqNullSafe(F.col("_l"))).where("_place <= _take").drop("_place", "_c", "_l", "_take")


def shard(rows: DataFrame, position: str, index: int, count: int) -> DataFrame:
    if not 0 <= index < count:
        raise ValueError("shard index outside the shard count")
    return rows.where(F.pmod(F.col(position), F.lit(count)) == index)


def excluding(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows that the other side does not use."""
    return rows.join(used.select(key).distinct(), key, "left_anti")


def source_selection(rows: DataFrame, strategy: str, n: int | None, order: str, label: str | None = None, seed: int = 0) -> DataFrame:
    """prefix, seeded_sample, stratified or all."""
    if n is None or strategy == "all":
        return rows
    if strategy == "prefix":
        return rows.orderBy(order).limit(n)
    if strategy == "seeded_sample":
        return rows.orderBy(seeded(seed, order), order).limit(n)
    if strategy == "stratified" and label:
        return cover_then_fill(rows, label, order, n).drop("covers")
    raise ValueError(f"unknown selection strategy: {strategy}")


def best_per_group(rows: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """The row of greatest value in each group, as clean-up keeps it (also for losses)."""
    return ranked(rows, [group], [F.desc_nulls_last(value), *ties], "_place").withColumn("keep", F.col("_place") == 1).drop("_place")
