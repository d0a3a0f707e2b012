"""Exact places within groups of any size, without a task that sees a whole group.

Rows are range-sorted by (group, order) and written. A row's place in its file range is its
number there; the ranges' counts per group, one row a range and group, give by prefix sums how
many rows of the group stand in earlier ranges, and that offset is joined to the rows. A group
that holds a third of all rows spreads over a third of the ranges; a window over the group would
sort it in one task.

Rows that are equal in every order column stay in one range, so the last order column should tell
rows apart; among equal rows the places are dealt arbitrarily, but each once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.sources.staging import staged


def _joined(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys, null equal to null, keeping the left ones."""
    named = other.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`") for c in other.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    return rows.join(named, on).drop(*[f"__r_{k}" for k in keys])


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], place: str = "place", size: str | None = None) -> DataFrame:
    """rows with their place (from 1) in the group by ``order``, and, if asked, the size of the group.

    No group columns: places in the whole table. Null keys form a group. Writes the rows once, so
    callers select what they need first.
    """
    by = [F.col(f"`{g}`") for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    laid = staged(numbered).withColumn("__range", F.shiftright("__at", 33))
    ranges = laid.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # At most one entry a range in a list. before: rows of the group in ranges with smaller numbers.
    lists = ranges.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__range", "__first", "__n"))).alias("__l"), F.sum("__n").alias("__size"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<__range:bigint,__first:bigint,__before:bigint>>").alias("out"))
    summed = F.aggregate("__l", nothing, lambda a, x: F.struct((a["total"] + x["__n"]).alias("total"), F.array_append(a["out"], F.struct(x["__range"].alias("__range"), x["__first"].alias("__first"), a["total"].alias("__before"))).alias("out")))
    offsets = lists.select(*group, "__size", F.explode(summed["out"]).alias("__o")).select(*group, "__size", "__o.*")
    told = _joined(laid, offsets, [*group, "__range"])
    out = [(F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(place)] + ([F.col("__size").alias(size)] if size else [])
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], *out)


def running_total(rows: DataFrame, order: Sequence[Column | str], value: Column | str, total: str = "total", place: str = "place") -> DataFrame:
    """rows with their place in the whole table (from 1) and the exact sum of ``value`` (whole numbers, null as 0) up to and with the row.

    Sums run within ranges of the order, each a task's, and the ranges' totals are joined as
    offsets: no task sees more than a range. Writes the rows once.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    worth = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("bigint"), F.lit(0))
    laid = staged(rows.withColumn("__v", worth).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    ranges = laid.groupBy("__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    # One entry a range.
    listed = ranges.agg(F.array_sort(F.collect_list(F.struct("__range", "__first", "__n", "__s"))).alias("__l")).select(F.explode(F.transform("__l", lambda x, i: F.struct(x["__range"].alias("__q"), x["__first"].alias("__first"), i.alias("__i")))).alias("__o"), "__l")
    part = lambda field: F.aggregate(F.slice("__l", 1, F.col("__o.__i")), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    offsets = listed.select("__o.__q", "__o.__first", part("__n").alias("__before"), part("__s").alias("__sum"))
    within = F.sum("__v").over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    told = laid.withColumn("__run", within).join(offsets, F.col("__range") == F.col("__q"))
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(place), (F.col("__run") + F.col("__sum")).alias(total))


def first_of_each(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each group: the first by ``order``, as a partial aggregate that meets per group one row a task."""
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_k{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), key)
    return rows.groupBy(*group).agg(best.alias("_b")).select("_b.*")
