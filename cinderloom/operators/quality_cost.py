"""Cycle metrics against token cost: running totals, areas, deltas, best cycles, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_tokens(cycles: DataFrame, run: str = "run_id", cycle: str = "cycle", tokens: str = "tokens") -> DataFrame:
    """cycles with cumulative_tokens. Runs partition the window, so no run meets another."""
    w = Window.partitionBy(run).orderBy(cycle).rowsBetween(Window.unboundedPreceding, 0)
    return cycles.withColumn("cumulative_tokens", F.sum(tokens).over(w))


def quality_cost_auc(points: DataFrame, keys: list[str], x: str, y: str, horizon: Column | None = None, name: str = "auc") -> DataFrame:
    """Mean height of the trapezoids through each key's points.

    A point at 0 repeats the first height; points beyond the horizon are left out without
    interpolation and the last height runs on to it. Null for a horizon of 0 or less.
    """
    w = Window.partitionBy(*keys).orderBy(x, y)
    h = horizon if horizon is not None else F.lit(None).cast("double")
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_h", h.cast("double"))
    p = p.withColumn("_x0", F.lag(x).over(w)).withColumn("_y0", F.lag(y).over(w)).withColumn("_n", F.row_number().over(w))
    inside = F.col("_h").isNull() | (F.col(x) <= F.col("_h"))
    step = F.when(F.col("_n") == 1, F.greatest(F.col(x), F.lit(0.0)) * F.col(y)).otherwise((F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2)
    last = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    g = p.groupBy(*keys).agg(
        F.first("_h").alias("_h"),
        F.sum(F.when(inside, step)).alias("_area"),
        F.max(F.when(inside, last)).alias("_last"),
        F.min(last).alias("_first"),
    )
    end = F.coalesce("_h", "_last.x")
    area = F.when(F.col("_last").isNull(), end * F.col("_first.y")).otherwise(F.col("_area") + (end - F.col("_last.x")) * F.col("_last.y"))
    return g.select(*keys, F.when(end > 0, area / end).alias(name))


def previous_delta(cycles: DataFrame, metric: str, run: str = "run_id", cycle: str = "cycle", name: str = "metric_delta") -> DataFrame:
    """Change since the cycle of the number before; 0 where that cycle is missing."""
    w = Window.partitionBy(run).orderBy(cycle)
    before = F.when(F.lag(cycle).over(w) == F.col(cycle) - 1, F.lag(metric).over(w))
    return cycles.withColumn(name, F.coalesce(F.col(metric) - before, F.lit(0.0)))


def best_first_final(cycles: DataFrame, metric: str, mode: str = "max", run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """First cycle that has the metric, the first extreme one, and the last cycle (null metric if it lacks one)."""
    sign = 1 if mode == "max" else -1
    has = F.col(metric).isNotNull()
    best = F.max(F.when(has, F.struct((sign * F.col(metric)).alias("v"), (-F.col(cycle)).alias("c"))))
    first, final = F.min(F.when(has, F.struct(cycle, metric))), F.max(F.struct(cycle, metric))
    return cycles.groupBy(run).agg(first.alias("f"), best.alias("b"), final.alias("l")).select(
        run, F.col(f"f.{cycle}").alias("first_cycle"), F.col(f"f.{metric}").alias("first_metric"), (-F.col("b.c")).alias("best_cycle"), (sign * F.col("b.v")).alias("best_metric"),
        F.col(f"l.{cycle}").alias("final_cycle"), F.col(f"l.{metric}").alias("final_metric"),
    )


def early_stopping(cycles: DataFrame, metric: str, patience: int = 2, min_delta: float = 0.0, mode: str = "max", run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """best_cycle, best_metric, stopped_cycle (null if it never stops).

    The best moves only beyond min_delta, so this is a fold over a run's cycles in order and not
    a running maximum. A run has few cycles; each is folded where its rows meet.
    """
    better = (lambda v, b: v < b - min_delta) if mode == "min" else (lambda v, b: v > b + min_delta)
    worst = float("inf") if mode == "min" else float("-inf")
    start = F.struct(F.lit(worst).alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop"))

    def fold(s: Column, p: Column) -> Column:
        up = better(p["m"], s["best"])
        wait = F.when(up, F.lit(0)).otherwise(s["wait"] + 1)
        moved = F.struct(F.when(up, p["m"]).otherwise(s["best"]).alias("best"), F.when(up, p["c"]).otherwise(s["at"]).alias("at"), wait.alias("wait"), F.when(wait >= patience, p["c"]).alias("stop"))
        return F.when(s["stop"].isNotNull() | p["m"].isNull(), s).otherwise(moved)

    ordered = F.array_sort(F.collect_list(F.struct(F.col(cycle).cast("int").alias("c"), F.col(metric).cast("double").alias("m"))))
    folded = cycles.groupBy(run).agg(F.aggregate(ordered, start, fold).alias("s"))
    return folded.select(run, F.col("s.at").alias("best_cycle"), F.when(F.col("s.at").isNotNull(), F.col("s.best")).alias("best_metric"), F.col("s.stop").alias("stopped_cycle"))


#: Metrics to look for, in this order, when none is named.
PREFERRED_METRICS = ("accuracy", "f1", "macro_f1", "exact_match", "eval_loss", "loss")


def chosen_metric(present: DataFrame, metric: str = "metric") -> str | None:
    """The first preferred metric that any row names."""
    order = F.array_position(F.array(*[F.lit(m) for m in PREFERRED_METRICS]), F.col(metric))
    row = present.where(order > 0).agg(F.min_by(metric, order)).first()
    return row[0]


def resolved_mode(metric: str, mode: str = "auto") -> str:
    """auto: least is best for losses and perplexity."""
    return mode if mode != "auto" else "min" if any(k in metric.lower() for k in ("loss", "perplexity")) else "max"
