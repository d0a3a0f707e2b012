"""Metrics as plug-ins: aggregates whose partial states merge, and metrics over tables of counts.

A ``Metric`` folds Arrow batches into a state on each task, states of a group merge in any
order, and the last state becomes a number: what leaves a task is a state a group and metric, and a
merging task sees one state a task. States have to stay small (counts by class, sums). A metric
whose exact value needs all distinct scores is a ``TableMetric``: a function of DataFrames.

``register`` adds either under a name; ``evaluated`` computes any of them for groups.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cinderloom.operators.ranks import running_total


@dataclass(frozen=True)
class Metric:
    """fold: a new state of columns (name to Arrow array) without nulls in them; merge: of two states one; finish: its value, None where undefined."""

    columns: tuple[str, ...]
    fold: Callable[[dict[str, pa.Array]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


@dataclass(frozen=True)
class TableMetric:
    """over(rows, group): group and value. Rows have the columns, without nulls in them."""

    columns: tuple[str, ...]
    over: Callable[[DataFrame, str], DataFrame]


METRICS: dict[str, Metric | TableMetric] = {}


def register(name: str, metric: Metric | TableMetric) -> None:
    METRICS[name] = metric


def _merged(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """group, metric, value of mergeable metrics, in one pass over the rows."""
    metrics = {n: METRICS[n] for n in names}
    columns = sorted({c for m in metrics.values() for c in m.columns})
    kind = rows.schema[group].dataType.simpleString()
    batch_kind = to_arrow_type(rows.schema[group].dataType)

    def partial(batches):
        states: dict[tuple, Any] = {}
        for batch in batches:
            table = pa.table(batch.columns, names=["g", *columns])
            for g in table.column("g").unique().to_pylist():
                of = table.column("g")
                own = table.filter(pc.is_null(of) if g is None else pc.fill_null(pc.equal(of, g), False))
                for n, m in metrics.items():
                    some = own.select(list(m.columns)).drop_null()
                    new = m.fold({c: some.column(c).combine_chunks() for c in m.columns})
                    states[g, n] = m.merge(states[g, n], new) if (g, n) in states else new
        keys = list(states)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], batch_kind), pa.array([k[1] for k in keys]), pa.array([pickle.dumps(states[k]) for k in keys], pa.binary())], ["g", "metric", "state"])

    def last(table: pa.Table) -> pa.Table:
        m = metrics[table.column("metric")[0].as_py()]
        value = m.finish(reduce(m.merge, map(pickle.loads, table.column("state").to_pylist())))
        return table.select(["g", "metric"]).slice(0, 1).append_column("value", pa.array([value], pa.float64()))

    states = rows.select(F.col(group).alias("g"), *columns).mapInArrow(partial, f"g {kind}, metric string, state binary")
    return states.groupBy("g", "metric").applyInArrow(last, f"g {kind}, metric string, value double").withColumnRenamed("g", group)


def evaluated(rows: DataFrame, names: list[str], group: str) -> DataFrame:
    """group, metric, value of each named metric for each group (null groups are one). Rows that lack what a metric needs do not count for it; an unknown name raises."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"no metrics {unknown}; there are {sorted(METRICS)}")
    merging = [n for n in names if isinstance(METRICS[n], Metric)]
    parts = [_merged(rows, group, merging)] if merging else []
    for n in names:
        if isinstance(m := METRICS[n], TableMetric):
            whole = rows.select(group, *m.columns).dropna(subset=list(m.columns))
            parts.append(m.over(whole, group).select(group, F.lit(n).alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)


def _confusion(columns: dict[str, pa.Array]) -> Counter:
    """Rows by (true, pred), counted by Arrow."""
    counts = pa.table(columns).group_by(["true", "pred"]).aggregate([([], "count_all")]).to_pydict()
    return Counter({(t, p): n for t, p, n in zip(counts["true"], counts["pred"], counts["count_all"])})


def _margins(c: Counter) -> tuple[int, int, Counter, Counter]:
    truths, told = Counter(), Counter()
    for (t, p), n in c.items():
        truths[t] += n
        told[p] += n
    return sum(c.values()), sum(n for (t, p), n in c.items() if t == p), truths, told


def kappa(c: Counter) -> float | None:
    """Agreement beyond that of independent draws."""
    n, hits, truths, told = _margins(c)
    chance = sum(truths[k] * told[k] for k in truths)
    return None if n == 0 or chance == n * n else (n * hits - chance) / (n * n - chance)


def matthews(c: Counter) -> float | None:
    """Correlation of truth and prediction over any number of classes; 0 where one side is constant."""
    n, hits, truths, told = _margins(c)
    if n == 0:
        return None
    spread = (n * n - sum(x * x for x in truths.values())) * (n * n - sum(x * x for x in told.values()))
    return 0.0 if spread == 0 else (n * hits - sum(truths[k] * told[k] for k in truths)) / math.sqrt(spread)


def auroc(rows: DataFrame, group: str) -> DataFrame:
    """Chance that a positive row outscores a negative one, ties by half: rank sums from counts by score and their running totals."""
    by_score = rows.groupBy(group, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    run = running_total(by_score, [group, "score"], "n", "_to").drop("place")
    # Totals run on through all groups; a group's own begin at its least.
    first = run.groupBy(F.col(group).alias("_g")).agg(F.min(F.col("_to") - F.col("n")).alias("_from"))
    own = run.join(first, F.col(group).eqNullSafe(F.col("_g")))
    below = F.col("_to") - F.col("_from") - F.col("n")
    sums = own.groupBy(group).agg(F.sum(F.col("p") * (below + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.withColumn("value", F.try_divide("u", F.col("p").cast("double") * F.col("n")))


register("kappa", Metric(("true", "pred"), _confusion, lambda a, b: a + b, kappa))
register("matthews", Metric(("true", "pred"), _confusion, lambda a, b: a + b, matthews))
register("auroc", TableMetric(("score", "positive"), auroc))
